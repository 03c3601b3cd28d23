"""Text clean-up: sizes, times, accounts, paths, model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .base import any_of, blank_to_null, choose, col, text

MODEL_SCHEMA = ("intent string, deviation string, explanation string, "
                "channels array<string>, risk_score string")
DOMAIN_COUNT = r"([a-zA-Z0-9.-]+\.[a-z]{2,6})×(\d+)(次| times)"


def excel_serial_ts(serial) -> Column:
    """Days since 1899-12-30 (fractional) as a timestamp; date text passes through."""
    total = F.round(col(serial).try_cast("double") * F.lit(86_400_000_000.0)).try_cast("bigint")
    day = F.lit(86_400_000_000)
    days = F.floor(total / day).cast("int")
    rest = F.pmod(total, day).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")
    shifted = (F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")
               + F.make_dt_interval(days, F.lit(0), F.lit(0), rest.cast("decimal(18,6)")))
    return F.coalesce(shifted, parse_time(col(serial)))


def parse_time(c) -> Column:
    """Four date spellings: '-' or '/', with or without seconds; anything else is null."""
    value = F.trim(text(c))
    formats = ("yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_size(c) -> Column:
    """'1,024 KB' -> bytes, truncated; an unknown unit counts as bytes, bad text as 0."""
    parts = F.split(F.trim(F.regexp_replace(text(c), ",", "")), r"\s+")
    number = F.get(parts, F.lit(0)).try_cast("double")
    factor = choose(F.upper(F.get(parts, F.lit(1))), vocab.SIZE_UNITS, 1)
    value = F.when(F.size(parts) == 2, number * factor).otherwise(number)
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def normalize_user(c) -> Column:
    """Drop a `DOMAIN\\` prefix."""
    return F.element_at(F.split(F.trim(text(c)), r"\\"), -1)


def clean_user(c) -> Column:
    """`name(name)` -> name, then drop a trailing parenthesis."""
    once = F.regexp_replace(F.trim(text(c)), r"^(.+?)\(\1\)$", "$1")
    return F.trim(F.regexp_replace(once, r"\([^)]*\)$", ""))


def person_from_host(c) -> Column:
    """`AB-CD-name` -> name, anything else unchanged."""
    return F.regexp_replace(text(c), r"^[A-Z]+-[A-Z]+-(.+)$", "$1")


def clean_account(c, suffixes=("corp", "example", "local")) -> Column:
    """Lower-case account without profile number and directory suffix."""
    lower = F.lower(F.trim(text(c)))
    dotted = any_of(suffixes)
    numbered = F.regexp_replace(lower, rf"\.{dotted}\.\d+$", "")
    return F.regexp_replace(numbered, rf"(?:\.{dotted})+$", "")


def account_from_path(source, destination) -> Column:
    """Login account in a `Users\\<account>\\` folder of the source, else destination path."""
    pattern = r"[Uu]sers[\\/]+([^\\/]+)[\\/]"
    return F.coalesce(blank_to_null(F.regexp_extract(text(source), pattern, 1)),
                      blank_to_null(F.regexp_extract(text(destination), pattern, 1)))


def account_key(c) -> Column:
    """Comparison key of an account: lower, no separators, no trailing digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[._-]", ""), r"\d+$", "")


def strip_site_prefix(c) -> Column:
    return F.trim(F.regexp_replace(text(c), r"^[A-Za-z]{2,6}(?:-[A-Za-z]{2,6})+-", ""))


def disk_channel(c) -> Column:
    """Disk type label -> LOCAL / USB / NETWORK / OTHER."""
    d = F.trim(text(c))
    return (F.when(d.isin("", "硬盘", "本地盘", "本地硬盘"), "LOCAL")
            .when(d.rlike("移动|U盘|可移动") | F.upper(d).contains("USB"), "USB")
            .when(d.rlike("网络|网盘|共享"), "NETWORK")
            .otherwise("OTHER"))


def doc_action(c) -> Column:
    return choose(F.trim(text(c)), vocab.DOC_ACTIONS, "UNKNOWN")


def doc_subtype_action(c) -> Column:
    return choose(text(c), vocab.DOC_SUBTYPES, "OPEN")


def device_channel(c) -> Column:
    return choose(text(c), vocab.DEVICE_CHANNELS, "LOCAL")


def file_ext(c) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(text(c), r"\.([A-Za-z0-9]{1,6})$", 1)))


def project_codes(c, most: int = 3) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(r"[A-Z]{2,6}[-_][0-9]{2,6}"), F.lit(0))
    return F.slice(found, 1, most)


def json_text(c, key: str) -> Column:
    return F.get_json_object(col(c), f"$.{key}")


def search_terms_from_url(c, params=("wd", "q", "query", "word")) -> Column:
    """Decoded query term of a search-engine URL, first parameter present."""
    found = F.coalesce(*[F.try_parse_url(col(c), F.lit("QUERY"), F.lit(p)) for p in params])
    return F.try_url_decode(found)


def strip_reasoning(c) -> Column:
    """Text without reasoning blocks, also when only the closing tag is left."""
    t = F.regexp_replace(text(c), r"(?s)<think>.*?</think>", "")
    dangling = t.contains("</think>") & ~t.contains("<think>")
    return F.when(dangling, F.regexp_replace(t, r"(?s)^.*?</think>", "")).otherwise(t)


def parse_model_output(c) -> Column:
    """Struct of verdict fields found in free model text: JSON first, patterns as fallback."""
    t = F.regexp_replace(strip_reasoning(c), r"```(?:json)?\s*", "")
    body = F.from_json(F.regexp_extract(t, r"(?s)\{.*\}", 0), MODEL_SCHEMA)

    def found(key: str, pattern: str) -> Column:
        return blank_to_null(F.regexp_extract(t, rf'"{key}"\s*:\s*{pattern}', 1))

    listed = F.transform(F.split(found("channels", r"\[([^\]]+)\]"), ","),
                         lambda x: F.regexp_replace(F.trim(x), r"""^["']+|["']+$""", ""))
    return F.struct(
        F.coalesce(body["intent"], found("intent", '"([^"]+)"')).alias("intent"),
        F.coalesce(body["deviation"], found("deviation", '"([^"]+)"')).alias("deviation"),
        F.coalesce(body["explanation"], found("explanation", '"([^"]+)"')).alias("explanation"),
        F.coalesce(body["channels"], F.filter(listed, lambda x: x != "")).alias("channels"),
        F.coalesce(body["risk_score"].try_cast("int"),
                   found("risk_score", r"(\d+)").try_cast("int")).alias("risk_score"),
    )


def correct_counts(c, counts) -> Column:
    """Put the counted visits into `domain×N times` claims of a text.

    `counts` maps a domain or its two-label root to the real number; claims
    about other domains stay.
    """
    counts = col(counts)
    claims = F.regexp_extract_all(text(c), F.lit(DOMAIN_COUNT), F.lit(0))

    def fix(acc, claim):
        written = F.regexp_extract(claim, DOMAIN_COUNT, 1)
        domain = F.lower(written)
        real = F.coalesce(F.try_element_at(counts, domain),
                          F.try_element_at(counts, F.substring_index(domain, ".", -2)))
        fixed = F.concat(written, F.lit("×"), real.cast("string"), F.regexp_extract(claim, DOMAIN_COUNT, 3))
        wrong = (real > 0) & (F.regexp_extract(claim, DOMAIN_COUNT, 2).try_cast("bigint") != real)
        return F.when(wrong, F.replace(acc, claim, fixed)).otherwise(acc)

    return F.aggregate(claims, text(c), fix)
