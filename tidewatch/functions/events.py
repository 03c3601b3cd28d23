"""Functions over canonical events: keys, time of day, flags, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..schema import OUTBOUND_ACTIONS, SCORE_TIERS, Rules
from ..vocab import DEFAULT, Vocabulary
from .base import col, contains_any, fmt_ts, from_micros, micros, ntz, text


def event_hash(ts="occurred_at", employee="employee_id", category="category",
               action="action", target="target_value") -> Column:
    """sha256 over time, person, category, action and target; microseconds only when present."""
    whole = fmt_ts(ts, "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.pmod(micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(
        fmt_ts(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.sha2(F.concat_ws("|", text(iso), text(employee), text(category), text(action), text(target)), 256)


def severity(score) -> Column:
    s = col(score)
    return (F.when(s >= 76, "CRITICAL").when(s >= 56, "HIGH").when(s >= 31, "MEDIUM").otherwise("LOW"))


def is_noise_doc(category="category", action="action", src_path="src_path", target="target_value") -> Column:
    """File activity of the system itself; sending or printing never is."""
    path = F.concat(F.lower(text(src_path)), F.lower(text(target)))
    return ((text(category) == "DOC") & ~text(action).isin(*OUTBOUND_ACTIONS)
            & contains_any(path, vocab.NOISE_PATHS))


def is_sensitive(c, v: Vocabulary = DEFAULT) -> Column:
    return contains_any(text(c), v.get("sensitive_keywords"))


def search_risky(c, v: Vocabulary = DEFAULT) -> Column:
    return contains_any(text(c), v.get("job_search_terms") + v.get("risk_search_terms")
                        + v.get("sensitive_keywords"))


def is_off_hours(ts, rules: Rules = Rules()) -> Column:
    h = F.hour(col(ts))
    return (h < rules.night_until) | (h >= rules.night_from)


def is_work_hours(ts) -> Column:
    """9-12 and 14-18."""
    h = F.hour(col(ts))
    return ((h >= 9) & (h < 12)) | ((h >= 14) & (h < 18))


def is_ip(c) -> Column:
    return text(c).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def is_person(c) -> Column:
    """Not empty, not an IPv4 or MAC address."""
    t = F.trim(text(c))
    mac = t.rlike(r"^[0-9a-fA-F]{2}(:[0-9a-fA-F]{2}){5}$") | t.rlike(r"^[0-9a-fA-F]{2}(-[0-9a-fA-F]{2}){5}$")
    return (text(c) != "") & ~is_ip(t) & ~mac


def is_visitor(c, min_digits: int = 1) -> Column:
    """All digits: any length at ingest, eight or more at scoring."""
    return text(c).rlike(rf"^\d{{{min_digits},}}$")


def is_named(c) -> Column:
    """Identifier holds a CJK character, i.e. is a resolved name."""
    return text(c).rlike("[一-鿿]")


def app_context(c) -> Column:
    app = F.lower(text(c))
    return (F.when(app.rlike("weixin|wechat"), "chat")
            .when(app.rlike("msedge|chrome|firefox"), "browser")
            .when(app.rlike("word|excel|powerpnt"), "office")
            .when(app.contains("explorer"), "file_manager")
            .otherwise(app))


def snap_tier(scenario, score) -> Column:
    """Smallest legal tier at or above the score, else the highest one."""
    out, s = None, col(score)
    for name, tiers in SCORE_TIERS.items():
        snapped = F.lit(max(tiers))
        for t in sorted(tiers, reverse=True):
            snapped = F.when(s <= t, F.lit(t)).otherwise(snapped)
        out = F.when(col(scenario) == name, snapped) if out is None else out.when(col(scenario) == name, snapped)
    return out.otherwise(s)


def time_bucket(ts, seconds: int = 600) -> Column:
    size = F.lit(seconds * 1_000_000)
    return from_micros(micros(ts) - F.pmod(micros(ts), size))


def day(ts) -> Column:
    return col(ts).cast("date")


def day_start(as_of: str, days_ago: int = 0) -> Column:
    """Midnight of the day `days_ago` before `as_of`."""
    return F.date_sub(ntz(as_of).cast("date"), days_ago).cast("timestamp_ntz")


def ago(as_of: str, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return ntz(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(0))


def since(rows: DataFrame, as_of: str, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows from some time before `as_of` on; tables stored by `event_date` are read only from that day on."""
    start = ago(as_of, days, hours)
    out = rows.filter(F.col("occurred_at") >= start)
    return out.filter(F.col("event_date") >= start.cast("date")) if "event_date" in rows.columns else out


def on_day(rows: DataFrame, day_: str, ts: str = "occurred_at", stored_by: str = "event_date") -> DataFrame:
    """Rows of a day, as a range that reaches the scan, and its partition where the table has one."""
    first = F.lit(day_).cast("date")
    out = rows.filter((F.col(ts) >= first.cast("timestamp_ntz")) & (F.col(ts) < F.date_add(first, 1).cast("timestamp_ntz")))
    return out.filter(F.col(stored_by) == first) if stored_by in rows.columns else out
