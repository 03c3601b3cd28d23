"""Domain rules: noise, suffix dictionaries, risk and leisure classes.

Suffix dictionaries are grouped by label count, so membership is a hash lookup
of the last k labels.  Everything stays a narrow projection on the fact rows:
no distinct pass, no join back and no shuffle that a popular domain could skew.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..vocab import DEFAULT, Vocabulary
from .base import any_of, choose, col, contains_any, starts_with_any, text


def url_domain(c) -> Column:
    """Authority of a URL, lower-case, without `www.`; port and user info stay."""
    url = text(c)
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.regexp_replace(F.lower(F.regexp_extract(full, r"^[^:/?#]+://([^/?#]*)", 1)), r"^www\.", "")


def last_labels(domain, k: int) -> Column:
    return F.substring_index(col(domain), ".", -k)


def suffix_in(domain, patterns) -> Column:
    """Domain equals a pattern or ends with '.' + pattern."""
    by_labels = defaultdict(list)
    for p in patterns:
        by_labels[p.count(".") + 1].append(p.lower())
    out = F.lit(False)
    for k in sorted(by_labels):
        out = out | last_labels(domain, k).isin(by_labels[k])
    return out


def match_domain(domain, patterns) -> Column:
    """Dotted patterns match as suffix, plain keywords anywhere."""
    dotted = [p for p in patterns if "." in p]
    plain = [p.lower() for p in patterns if p and "." not in p]
    return suffix_in(domain, dotted) | contains_any(domain, plain)


def domain_class(domain, v: Vocabulary = DEFAULT) -> Column:
    """Substring class used on endpoint web rows."""
    d = F.lower(text(domain))
    return (F.when(contains_any(d, v.get("netdisk_domains")), "netdisk")
            .when(contains_any(d, v.get("personal_email_domains")), "personal_email")
            .when(contains_any(d, v.get("recruitment_sites")), "recruitment")
            .otherwise("other"))


def is_noise_web(domain, url) -> Column:
    """Certificate, CDN, tracker host or a static resource."""
    static = any_of(vocab.NOISE_EXTENSIONS, prefix=r"(?s)^[^/]*/[^/]*/[^/]*/[^?]*\.", suffix=r"(?:\?.*)?\z")
    return contains_any(F.lower(text(domain)), vocab.NOISE_HINTS) | F.lower(text(url)).rlike(static)


def risk_class(domain, v: Vocabulary = DEFAULT) -> Column:
    """First matching risk class, null for whitelisted and unlisted domains."""
    d = F.lower(text(domain))
    listed = match_domain(d, [p for _, dictionary, _ in vocab.RISK_CLASSES for p in v.get(dictionary)])
    # Most hosts are in no dictionary: one combined lookup settles them.
    out = F.when((d == "") | ~listed | suffix_in(d, v.get("risk_whitelist_domains")), F.lit(None).cast("string"))
    for label, dictionary, _ in vocab.RISK_CLASSES:
        out = out.when(match_domain(d, v.get(dictionary)), F.lit(label))
    return out


def risk_tier(risk) -> Column:
    """high / mid / job of a risk class."""
    return choose(risk, {label: tier for label, _, tier in vocab.RISK_CLASSES})


def is_heartbeat(domain, risk) -> Column:
    """Background sign-in of a remote-control client."""
    d = F.lower(text(domain))
    return F.coalesce(col(risk) == "remote_control", F.lit(False)) & (
        d.startswith("auth") | d.contains("authds"))


def is_telemetry(domain) -> Column:
    return starts_with_any(F.lower(text(domain)), vocab.TELEMETRY_PREFIXES)


def is_major_recruitment(domain) -> Column:
    return contains_any(F.lower(text(domain)), vocab.MAJOR_RECRUITMENT)


def leisure_class(domain, label, v: Vocabulary = DEFAULT) -> Column:
    """Leisure category of a visit: proxy label first, domain dictionary second."""
    d = F.lower(text(domain))
    lab = F.trim(text(label))
    none = F.lit(None).cast("string")
    out = F.when((d == "") | contains_any(d, vocab.SDK_HINTS)
                 | suffix_in(d, v.get("slack_sdk_domains"))
                 | suffix_in(d, v.get("slack_whitelist_domains"))
                 | contains_any(d, vocab.INFRA_HINTS)
                 | contains_any(lab, vocab.OFFICE_CHAT_LABELS), none)
    leisure_label = contains_any(lab, vocab.LEISURE_LABELS) & ~contains_any(lab, vocab.LEISURE_LABEL_VETO)
    for keyword, category in vocab.LEISURE_LABEL_CATEGORY:
        out = out.when(leisure_label & lab.contains(keyword), F.lit(category))
    for category, patterns in v.categories.get("slack_domains", {}).items():
        out = out.when(suffix_in(d, patterns), F.lit(category))
    return out


def is_work_domain(domain, v: Vocabulary = DEFAULT) -> Column:
    return suffix_in(F.lower(text(domain)), v.get("work_domains"))


def dest_root(path) -> Column:
    """First path segment of a destination, lower-case."""
    return F.lower(F.substring_index(text(path), "/", 1))


def is_whitelisted_dest(path, v: Vocabulary = DEFAULT) -> Column:
    return suffix_in(dest_root(path), v.get("risk_whitelist_domains"))
