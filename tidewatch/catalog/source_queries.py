"""Readers of exported files, over events rendered as exports with quoted line ends and a hundred columns."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.base import fmt_ts, text
from ..session import checkpoint_dir
from ..sources import files as S
from .base import *

FILLER = 85  # columns nobody knows, before and between the known ones


def header_of(name: str, aliases: dict) -> str:
    return next(k for k, x in aliases.items() if x == name)


def render(rows: DataFrame, aliases: dict, cells: dict[str, Column], folder: str, sep: str = ",") -> str:
    """Write rows as export files of about a hundred columns, quoted, the known ones after cell 64."""
    filler = [F.lit(str(k)).alias(f"x{k}") for k in range(FILLER)]
    known = [c.alias(header_of(name, aliases)) for name, c in cells.items()]
    out = os.path.join(folder, uuid.uuid4().hex)
    # Spread first: a hundred cells a row are more work than the row groups of the table show.
    (rows.repartition("event_id").select(*filler[:70], *known[:2], *filler[70:], *known[2:]).write.option("header", True).option("sep", sep).option("quoteAll", True)
     .option("escape", '"').option("emptyValue", "").csv(out))
    return out


def place(spark) -> str:
    return os.path.join(checkpoint_dir(spark), "exports", uuid.uuid4().hex)


def title() -> Column:
    return F.concat(F.lit('first line\nsaid "yes", number '), F.col("event_id").cast("string"), F.lit("\n"))


TITLE_SQL = "trim('first line' || chr(10) || 'said \"yes\", number ' || event_id || chr(10), ' ' || chr(10))"


def proxy_export(spark, sf, sep: str = ",") -> str:
    e = ev(spark, sf).filter("category = 'WEB'")
    return render(e, vocab.PROXY_HEADERS, {
        "user": F.concat("employee_id", F.lit("("), "employee_id", F.lit(")")), "time": fmt_ts("occurred_at"), "src_ip": text("device_id"), "category": text("site_class"),
        "title": title(), "domain": text("domain"), "url": F.concat(F.lit("http://"), text("domain"), F.lit("/"), F.col("event_id").cast("string"))}, place(spark), sep)


PROXY_SQL = with_("canon", f"""select employee_id, date_trunc('second', occurred_at) as occurred_at, domain, 'http://' || domain || '/' || event_id as url, {TITLE_SQL} as title,
 coalesce(site_class, '') as site_class from canon where category = 'WEB' and coalesce(domain, '') <> ''""")
PROXY_COLUMNS = ["employee_id", "occurred_at", "domain", "url", "title", "site_class"]


@register("s01_proxy_export", PROXY_SQL)
def s01(spark, sf):
    """Proxy export, comma separated."""
    return S.read_proxy_export(spark, proxy_export(spark, sf)).select(*PROXY_COLUMNS)


@register("s01_proxy_export_tabs", PROXY_SQL)
def s01_tabs(spark, sf):
    return S.read_proxy_export(spark, proxy_export(spark, sf, "\t")).select(*PROXY_COLUMNS)


def serial_day(c: str = "occurred_at") -> Column:
    return fmt_ts(c)


def doc_export(spark, sf, folder: str) -> str:
    e = ev(spark, sf).filter("category = 'DOC'")
    return render(e, vocab.ENDPOINT_HEADERS, {
        "type": F.when(F.col("event_id") % 9 == 0, "").otherwise("复制"), "time": serial_day(), "computer": F.concat(F.lit("HQ-BJ-"), "employee_id"), "source_file": text("target_value"),
        "size": F.concat(F.col("event_id").cast("string"), F.lit(" KB")), "title": title(), "path": F.lit("C:\\a\\b")}, folder)


def web_export(spark, sf, folder: str) -> str:
    e = ev(spark, sf).filter("category = 'WEB'")
    return render(e, vocab.ENDPOINT_HEADERS, {"time": serial_day(), "url": F.concat(F.lit("https://www."), text("domain"), F.lit("/"), F.col("event_id").cast("string")),
                                              "computer": F.concat(F.lit("HQ-BJ-"), "employee_id"), "title": title()}, folder)


def search_export(spark, sf, folder: str) -> str:
    e = ev(spark, sf).filter("category = 'SEARCH'")
    return render(e, vocab.ENDPOINT_HEADERS, {"time": serial_day(), "keyword": text("target_value"), "computer": F.concat(F.lit("HQ-BJ-"), "employee_id"), "application": F.lit("app")}, folder)


DOC_SQL = f"""select employee_id, date_trunc('second', occurred_at) as occurred_at, 'COPY' as action, trim(coalesce(target_value, '')) as target_value, (event_id * 1024)::bigint as size_bytes, {TITLE_SQL} as title
 from canon where category = 'DOC' and event_id % 9 <> 0"""
WEB_SQL = f"""select employee_id, date_trunc('second', occurred_at) as occurred_at, 'VISIT' as action, 'https://www.' || coalesce(domain, '') || '/' || event_id as target_value, 0::bigint as size_bytes, {TITLE_SQL} as title
 from canon where category = 'WEB'"""
SEARCH_SQL = """select employee_id, date_trunc('second', occurred_at) as occurred_at, 'SEARCH' as action, trim(target_value) as target_value, 0::bigint as size_bytes, null::varchar as title
 from canon where category = 'SEARCH' and trim(coalesce(target_value, '')) not in ('', 'None')"""
COLUMNS = ["employee_id", "occurred_at", "action", "target_value", "size_bytes", "title"]


@register("s02_document_export", with_("canon", DOC_SQL))
def s02(spark, sf):
    return S.read_doc_log(spark, doc_export(spark, sf, place(spark))).select(*COLUMNS)


@register("s03_web_export", with_("canon", WEB_SQL))
def s03(spark, sf):
    return S.read_web_log(spark, web_export(spark, sf, place(spark))).select(*COLUMNS)


@register("s04_search_export", with_("canon", SEARCH_SQL))
def s04(spark, sf):
    return S.read_search_log(spark, search_export(spark, sf, place(spark))).select(*COLUMNS)


@register("s05_export_folder", with_("canon", f"{DOC_SQL} union all {WEB_SQL} union all {SEARCH_SQL}"))
def s05(spark, sf):
    """A folder with files of all kinds, whose names tell nothing."""
    folder = place(spark)
    for write in (doc_export, web_export, search_export):
        write(spark, sf, folder)
    return S.read_endpoint_folder(spark, folder).rows.select(*COLUMNS)


@register("s05_unread_files", with_("canon", "select 'strange' as kind, count(*)::bigint + 1 as n_lines from canon where category = 'SEARCH'"))
def s05_unread(spark, sf):
    """Files without a known header are listed with their lines."""
    folder = place(spark)
    search_export(spark, sf, folder)
    e = ev(spark, sf).filter("category = 'SEARCH'")
    out = os.path.join(folder, "strange")
    e.select(F.col("event_id").cast("string").alias("a"), "employee_id").coalesce(1).write.option("header", True).csv(out)
    found = S.read_endpoint_folder(spark, folder).unread
    return found.groupBy(F.when(F.contains("file", F.lit("/strange/")), "strange").otherwise(F.col("file")).alias("kind")).agg(F.sum("n_lines").alias("n_lines"))


@register("s06_canonical_replay", with_("canon", """select employee_id, date_trunc('second', occurred_at) as occurred_at, category, action, target_value, size_bytes, "count" from canon"""))
def s06(spark, sf):
    """The canonical nine-column file, written and read back."""
    out = os.path.join(place(spark), "replay")
    e = ev(spark, sf)
    (e.select(fmt_ts("occurred_at").alias("occurred_at"), *[F.col(c).cast("string") for c in S.REPLAY_COLUMNS[1:]])
     .write.option("header", True).option("escape", '"').csv(out))
    return S.read_canonical_csv(spark, out).select("employee_id", "occurred_at", "category", "action", "target_value", "size_bytes", "count")
