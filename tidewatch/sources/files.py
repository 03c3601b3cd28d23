"""Exported log files (CSV or TSV) of both feeds, and the canonical replay file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions import domains as D
from ..functions import events as E
from ..functions import parsing as P
from ..functions.base import blank_to_null, text
from ..schema import CANONICAL, to_canonical
from ..session import cut_lineage

# ------------------------------------------------------------------ records
#
# A record may hold quoted line ends, so it can begin in one input split and end in the next.  Both passes below read
# the physical lines of a split in order.  The first notes, for either separator, how a split ends if it begins outside
# or inside a quoted cell, and the header lines it sees.  From that the start of every split follows, and the second pass
# cuts records and cells.  Only records that cross a split border are put together in a shuffle.

SEPARATORS = (",", "\t")
FILES = 100_000


def physical_lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, value): lines of all text files of a path; a task reads a block in order."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _record_tools():
    """Helpers of both passes; made in a function so that they travel by value."""
    import re
    # A quote opens a cell at its start only; the first quote that is not doubled closes it.  Both patterns take as many
    # cells as end on the line and never go back; what they leave begins with the cell that stays open.
    rest = r'[^"]*+(?:""[^"]*+)*+"[^{s}]*+'
    cell = rf'(?:"{rest}|[^"{{s}}][^{{s}}]*+)?+'
    outside = {s: re.compile(rf"{cell}(?:{{s}}{cell})*+".format(s=s)) for s in (",", "\t")}
    within = {s: re.compile(rf"{rest}(?:{{s}}{cell})*+".format(s=s)) for s in (",", "\t")}

    def after(line: str, sep: str, inside: bool) -> bool:
        """Whether a quoted cell is still open at the end of a line."""
        if '"' not in line:
            return inside
        met = (within if inside else outside)[sep].match(line)
        return met is None or met.end() < len(line)

    def cells(record: str, sep: str) -> list[str]:
        import csv
        csv.field_size_limit(2**31 - 1)
        rows = list(csv.reader([x + "\n" for x in record.split("\n")], delimiter=sep))
        return [c.strip() for c in rows[0]] if rows else []

    def by_block(parts):
        """(file, block, lines) of batches; a block may go on in the next item."""
        import pyarrow.compute as pc
        for part in parts:
            if not part.num_rows:
                continue
            files, blocks = (pc.run_end_encode(part.column(c)) for c in (0, 1))
            ends = sorted({*files.run_ends.to_pylist(), *blocks.run_ends.to_pylist()})
            values = [(v or "").replace("\ufeff", "") for v in part.column(2).to_pylist()]
            start = 0
            for k in ends:
                yield part.column(0)[start].as_py(), part.column(1)[start].as_py(), values[start:k]
                start = k

    return after, cells, by_block


SCAN = "file string, block long, sep string, open0 boolean, open1 boolean, names array<string>, n_lines long"


def scan_blocks(lines: DataFrame, aliases: dict, required: dict[str, tuple]) -> DataFrame:
    """Per block and separator its ends (`open0` from outside, `open1` from inside a cell); per header line its names."""
    after, cells, by_block = _record_tools()

    def run(parts):
        import pyarrow as pa
        hints = [[[v for v in aliases if aliases[v] == n] for n in need] for need in required.values()]
        state, ends, count = None, {}, 0

        def close():
            return [(*state, s, *e, None, count) for s, e in ends.items()] if state else []

        for file, block, values in by_block(parts):
            out = []
            if (file, block) != state:
                out += close()
                state, ends, count = (file, block), {s: (False, True) for s in (",", "\t")}, 0
            for line in values:
                count += line.strip() != ""
                for sep in (",", "\t"):
                    if '"' in line:
                        zero, one = ends[sep]
                        end = after(line, sep, zero)
                        ends[sep] = end, end if zero == one else after(line, sep, one)  # once alike, alike to the end
                # A header names all columns of some kind; most lines fail the first look.
                if any(all(any(h in line for h in hint) for hint in need) for need in hints):
                    for sep in (",", "\t"):
                        names = [aliases.get(c, "") for c in cells(line, sep)]
                        if any(all(n in names for n in need) for need in required.values()):
                            out.append((file, block, sep, None, None, names, 0))
            if out:
                yield record_batch(pa, out)
        if (out := close()):
            yield record_batch(pa, out)

    def record_batch(pa, rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "block", "sep", "open0", "open1", "names", "n_lines"])

    return lines.mapInArrow(run, SCAN)


def file_layouts(scan: DataFrame) -> DataFrame:
    """(file, sep, names) of files with a header: of several header lines the one with most names."""
    heads = scan.filter("names is not null")
    count = F.size(F.array_distinct(F.filter("names", lambda n: n != "")))
    return heads.groupBy("file").agg(F.max(F.struct(count.alias("n"), "sep", "names")).alias("l")).select("file", "l.sep", "l.names")


def block_starts(scan: DataFrame) -> DataFrame:
    """(file, sep, block) of blocks that begin inside a quoted cell.

    A block maps its start to its end; those that end alike whatever their start fix the state, the others keep or swap it.
    """
    from pyspark.sql import Window
    ends = scan.filter("names is null")
    order = Window.partitionBy("file", "sep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    swaps = F.coalesce(F.sum(F.when(F.col("open0") & ~F.col("open1"), 1).otherwise(0)).over(order), F.lit(0))
    upto = F.sum(F.when(F.col("open0") & ~F.col("open1"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fixed = F.when(F.col("open0") == F.col("open1"), F.struct(F.col("open0").cast("int").alias("value"), "upto"))
    marked = ends.withColumn("swaps", swaps).withColumn("upto", upto).withColumn("fixed", fixed)
    last = F.last("fixed", ignorenulls=True).over(order)
    state = F.pmod(F.coalesce(last["value"], F.lit(0)) + F.col("swaps") - F.coalesce(last["upto"], F.lit(0)), F.lit(2))
    return marked.withColumn("state", state).filter("state = 1").select("file", "sep", "block")


RECORDS = "file string, block long, place int, cells array<string>, piece string"


def _placed(layouts: DataFrame, aliases: dict) -> DataFrame:
    """Layouts with `at`: for every alias name the place of its column from 1 on, 0 if the file lacks it."""
    return layouts.withColumn("at", F.array(*[F.array_position("names", n).cast("int") for n in dict.fromkeys(aliases.values())]))


def _named_cells(aliases: dict, required: dict[str, tuple]):
    """A function of a record's cells and its file's `at`: the cells of the alias names, or None for headers and titles."""
    kinds = [set(need) for need in required.values()]

    def named(cells: list[str], at: list[int]) -> list[str] | None:
        if sum(map(bool, cells)) < 2:  # a title fills a single cell
            return None
        if not aliases.keys().isdisjoint(cells):
            own = {aliases[c] for c in cells if c in aliases}
            if any(need <= own for need in kinds):
                return None
        return [cells[k - 1] if 0 < k <= len(cells) else "" for k in at]

    return named


def read_records(lines: DataFrame, layouts: DataFrame, starts: DataFrame, aliases: dict | None = None, required: dict[str, tuple] | None = None) -> DataFrame:
    """(file, cells): records of the files that have a layout.

    With `aliases`, `cells` are those of the alias names in their order, and headers and titles (a single filled cell) are
    left out.
    """
    layouts = layouts.withColumn("at", F.array().cast("array<int>")) if aliases is None else _placed(layouts, aliases)
    named = (lambda row, at: row) if aliases is None else _named_cells(aliases, required)
    known = cut_lineage(layouts.join(starts.groupBy("file", "sep").agg(F.collect_set("block").alias("inside")), ["file", "sep"], "left").select("file", "sep", "inside", "at"))
    # Lines must stay in order, so what is known about their file comes to them: a hundred bytes a file, FILES at a time.
    groups = max(1, -(-known.count() // FILES))
    keyed = None
    for g in range(groups):
        mine = (lambda df: df) if groups == 1 else (lambda df, g=g: df.filter(F.pmod(F.xxhash64("file"), F.lit(groups)) == g))
        part = mine(lines).join(F.broadcast(mine(known)), "file").select("file", "block", "value", "sep", F.coalesce(F.array_contains("inside", F.col("block")), F.lit(False)).alias("inside"), "at")
        keyed = part if keyed is None else keyed.unionByName(part)
    after, cells, by_block = _record_tools()

    def run(parts):
        import pyarrow as pa
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
        state, sep, at, inside, held, at_start = None, None, [], False, [], False

        def flush(out):
            """What is open at the end of a block goes on in the next one."""
            if state and (held or inside):
                out.append((*state, 0 if at_start else 1, None, "\n".join(held)))

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["file", "block", "place", "cells", "piece"])

        for part in parts:
            done, out = 0, []
            for file, block, values in by_block([part.select([0, 1, 2])]):
                if (file, block) != state:
                    flush(out)
                    state, held = (file, block), []
                    sep, inside, at = (part.column(c)[done].as_py() for c in (3, 4, 5))
                    at_start = inside
                done += len(values)
                for line in values:
                    if not inside and not held and not line.strip():
                        continue
                    held.append(line)
                    inside = after(line, sep, inside)
                    if not inside:
                        record = "\n".join(held)
                        if at_start:
                            out.append((*state, 0, None, record))
                        elif (row := named(cells(record, sep), at)) is not None:
                            out.append((*state, None, row, None))
                        held, at_start = [], False
            if out:
                yield batch(out)
        out = []
        flush(out)
        if out:
            yield batch(out)

    # Lines are cut once: whole records and pieces come from the same written table, which holds the named cells only.
    found = cut_lineage(keyed.mapInArrow(run, RECORDS))
    whole = found.filter("cells is not null").select("file", "cells")
    # Pieces of records that cross a border: in a file, each run of pieces from one that begins outside a cell.
    from pyspark.sql import Window
    pieces = found.filter("piece is not null")
    order = Window.partitionBy("file").orderBy("block", "place")
    runs = pieces.withColumn("run", F.sum("place").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("file", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "piece"))), lambda x: x["piece"]), "\n").alias("record"))
    joined = joined.join(layouts.select("file", "sep", "at"), "file").select("file", "sep", "record", "at")

    def cut(parts):
        import pyarrow as pa
        for part in parts:
            files, seps, records, places = (part.column(c).to_pylist() for c in range(4))
            rows = [(f, row) for f, s, r, at in zip(files, seps, records, places) if (row := named(cells(r, s), at)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([row for _, row in rows], pa.list_(pa.string()))], ["file", "cells"])

    return whole.unionByName(joined.mapInArrow(cut, "file string, cells array<string>"))


def named_rows(records: DataFrame, layouts: DataFrame, aliases: dict, required: dict[str, tuple]) -> DataFrame:
    """(file, kinds, one column per alias name) of records read with `aliases`.

    `kinds` are those of `required` whose columns the file has.
    """
    has = [F.when(F.forall(F.array(*map(F.lit, need)), lambda r: F.array_contains("names", r)), F.lit(kind)) for kind, need in required.items()]
    kinds = layouts.select("file", F.array_compact(F.array(*has)).alias("kinds"))
    return records.join(kinds, "file").select("file", "kinds", *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(dict.fromkeys(aliases.values()))])


@dataclass
class Export:
    """Rows of a set of export files, and the files that gave none."""
    rows: DataFrame
    unread: DataFrame   # (file, n_lines) of files without a known header


def read_exports(spark: SparkSession, path, aliases: dict, required: dict[str, tuple]) -> Export:
    lines = physical_lines(spark, path)
    scan = cut_lineage(scan_blocks(lines, aliases, required))  # two rows a split and the header lines
    layouts = file_layouts(scan)
    records = read_records(lines, layouts, block_starts(scan), aliases, required)
    counts = scan.filter("names is null and sep = ','").groupBy("file").agg(F.sum("n_lines").alias("n_lines")).filter("n_lines > 0")
    return Export(named_rows(records, layouts, aliases, required), counts.join(layouts.select("file"), "file", "left_anti"))


def read_export(spark: SparkSession, path, aliases: dict, required: tuple) -> DataFrame:
    """All cells as text under their alias names; a file without a header line is an error."""
    found = read_exports(spark, path, aliases, {"all": required})
    lost = found.unread.orderBy("file").limit(5).collect()
    if lost:
        raise ValueError("no header line in " + ", ".join(r["file"] for r in lost))
    return found.rows.drop("file", "kinds")


def proxy_events(rows: DataFrame) -> DataFrame:
    """Canonical WEB events of proxy export rows; rows without a domain are dropped."""
    raw = F.create_map(*[x for k in ("group", "src_ip", "terminal", "dst_ip", "access", "decrypt")
                         for x in (F.lit(k), F.col(k))])
    e = rows.filter("domain <> ''").select(
        P.parse_time("time").alias("occurred_at"),
        F.coalesce(blank_to_null(P.clean_user("user")), blank_to_null("src_ip"), F.lit("unknown")).alias("employee_id"),
        F.col("src_ip").alias("device_id"), F.lit("WEB").alias("category"), F.lit("VISIT").alias("action"),
        F.lit("URL").alias("target_type"), F.coalesce(blank_to_null("url"), F.col("domain")).alias("target_value"),
        F.lit(0).alias("size_bytes"), F.lit(1).alias("count"), F.lit("proxy").alias("source"), "domain",
        F.coalesce(blank_to_null("url"), F.col("domain")).alias("url"), "title", F.col("category").alias("site_class"),
        raw.alias("raw"))
    return to_canonical(e.withColumn("event_hash", E.event_hash()))


def read_proxy_export(spark: SparkSession, path) -> DataFrame:
    return proxy_events(read_export(spark, path, vocab.PROXY_HEADERS, ("user", "time", "domain")))


def _endpoint(category: str, action, target_type: str, target, **more) -> Column:
    """A canonical event as a struct over the columns of an endpoint export."""
    raw = F.create_map(*[x for k, c in more.pop("raw").items() for x in (F.lit(k), c if isinstance(c, Column) else F.col(c))])
    own = {"occurred_at": P.excel_serial_ts("time"), "employee_id": P.person_from_host("computer"), "device_id": F.col("computer"), "category": F.lit(category),
           "action": action, "target_type": F.lit(target_type), "target_value": target, "size_bytes": F.lit(0), "count": F.lit(1), "source": F.lit("endpoint"), "raw": raw, **more}
    own["event_hash"] = E.event_hash(*[own[k] for k in ("occurred_at", "employee_id", "category", "action", "target_value")])
    return F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL.fields])


def _same(*names: str) -> dict:
    return {n: n for n in names}


def document_event() -> Column:
    raw = {"op_type": "type", **_same("computer_group", "user_group"), "user_raw": "user", **_same("path", "disk_type", "application")}
    event = _endpoint("DOC", P.doc_action("type"), "FILE", F.col("source_file"), size_bytes=P.parse_size("size"), channel=P.disk_channel("disk_type"),
                      app=F.col("application"), title=F.col("title"), src_path=F.col("path"), raw=raw)
    return F.when(~F.col("type").isin("", "None"), event)


def web_event() -> Column:
    domain = D.url_domain("url")
    raw = {"domain_class": D.domain_class(domain), **_same("computer_group", "user_group"), "user_raw": "user"}
    event = _endpoint("WEB", F.lit("VISIT"), "URL", F.col("url"), domain=domain, url=F.col("url"), title=F.col("title"), raw=raw)
    return F.when(~F.col("url").isin("", "None"), event)


def search_event() -> Column:
    raw = {**_same("keyword", "search_engine", "application", "computer_group", "user_group"), "user_raw": "user"}
    event = _endpoint("SEARCH", F.lit("SEARCH"), "KEYWORD", F.col("keyword"), app=F.col("application"), raw=raw)
    return F.when(~F.col("keyword").isin("", "None"), event)


ENDPOINT_KINDS = {
    "doc": (("type", "time"), document_event, ("文档", "doc")),
    "web": (("time", "url"), web_event, ("网页", "上网", "web")),
    "search": (("time", "keyword"), search_event, ("搜索", "关键字", "search")),
}


def _events(rows: DataFrame, kinds: Column) -> DataFrame:
    """Canonical events of endpoint rows for each of their kinds: one pass over the rows."""
    each = [F.when(F.array_contains(kinds, kind), build()) for kind, (_, build, _) in ENDPOINT_KINDS.items()]
    return rows.select(F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.*")


def _read_endpoint(spark: SparkSession, path, kind: str) -> DataFrame:
    return _events(read_export(spark, path, vocab.ENDPOINT_HEADERS, ENDPOINT_KINDS[kind][0]), F.array(F.lit(kind)))


def read_doc_log(spark: SparkSession, path) -> DataFrame:
    return _read_endpoint(spark, path, "doc")


def read_web_log(spark: SparkSession, path) -> DataFrame:
    return _read_endpoint(spark, path, "web")


def read_search_log(spark: SparkSession, path) -> DataFrame:
    return _read_endpoint(spark, path, "search")


def _kind_by_name(file: Column) -> Column:
    """The kind a file's name tells, or null."""
    name = F.lower(F.url_decode(F.replace(F.element_at(F.split(file, "/"), -1), F.lit("+"), F.lit("%2B"))))
    kind = F.lit(None).cast("string")
    for k, (_, _, words) in reversed(ENDPOINT_KINDS.items()):
        kind = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w)), k).otherwise(kind)
    return kind


def read_endpoint_folder(spark: SparkSession, path: str) -> Export:
    """Canonical events of all endpoint exports of a folder, and the files that could not be read.

    A file whose name tells its kind counts as that kind if its header has the columns; others count as every kind whose
    header they have.  What is left is listed, never dropped in silence.
    """
    required = {k: need for k, (need, _, _) in ENDPOINT_KINDS.items()}
    found = read_exports(spark, path, vocab.ENDPOINT_HEADERS, required)
    told = _kind_by_name(F.col("file"))
    kinds = F.when(told.isNull(), F.col("kinds")).otherwise(F.array_intersect("kinds", F.array(told)))
    # A named file whose header is one of another kind gives no row: it is unread, too.
    rows = found.rows.withColumn("kinds", kinds)
    wrong = rows.groupBy("file").agg(F.count("*").alias("n_lines"), F.max(F.size("kinds")).alias("k")).filter("k = 0").select("file", "n_lines")
    return Export(_events(rows, F.col("kinds")), found.unread.unionByName(wrong))


def read_endpoint_dir(spark: SparkSession, path: str) -> DataFrame:
    """Events of `read_endpoint_folder`; a file whose name tells its kind but has no header of it is an error."""
    found = read_endpoint_folder(spark, path)
    lost = found.unread.filter(_kind_by_name(F.col("file")).isNotNull()).orderBy("file").limit(5).collect()
    if lost:
        raise ValueError("no header line in " + ", ".join(r["file"] for r in lost))
    return found.rows


REPLAY_COLUMNS = ["occurred_at", "employee_id", "device_id", "category", "action", "target_type", "target_value",
                  "size_bytes", "count"]


def read_canonical_csv(spark: SparkSession, path) -> DataFrame:
    """Nine-column CSV that is already canonical."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REPLAY_COLUMNS])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    e = (rows.withColumn("occurred_at", P.parse_time("occurred_at"))
         .withColumn("size_bytes", F.coalesce(F.col("size_bytes").try_cast("bigint"), F.lit(0)))
         .withColumn("count", F.coalesce(F.col("count").try_cast("int"), F.lit(1))))
    return to_canonical(e.withColumn("event_hash", E.event_hash()))


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, unusable) events: a row without a readable time never gets a made-up one."""
    return events.filter("occurred_at is not null"), events.filter("occurred_at is null")
