import json

import pytest
from pyspark.sql import functions as F

from tidewatch import vocab
from tidewatch.operators.identity import resolve_identity
from tidewatch.plans import reports as R
from tidewatch.sources import files as S
from tidewatch.sources import messages as M
from tidewatch.sources import sinks as K


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_proxy_export_with_title_row_and_bom(spark, tmp_path):
    head = ["序号", "用户名", "源IP", "网站分类", "访问域名", "URL地址", "时间"]
    body = ["1,li(li),192.0.2.1,IT,a.org,http://a.org/x,2026-07-22 10:00:00",
            "2,,192.0.2.2,IT,b.org,,2026/07/22 10:01",
            "3,wang (ops),192.0.2.3,IT,,http://c.org,2026-07-22 10:02:00",
            "4,wang,192.0.2.3,\"IT, web\",d.org,http://d.org/a,not a time"]
    f = tmp_path / "export.csv"
    f.write_text("\ufeffreport\n" + ",".join(head) + "\n" + "\n".join(body) + "\n", encoding="utf-8")
    df = S.read_proxy_export(spark, str(f))
    assert rows(df, "employee_id", "domain", "target_value", "site_class") == [
        ("192.0.2.2", "b.org", "b.org", "IT"), ("li", "a.org", "http://a.org/x", "IT"),
        ("wang", "d.org", "http://d.org/a", "IT, web")]
    good, bad = S.quarantine(df)
    assert good.count() == 2 and [r["employee_id"] for r in bad.collect()] == ["wang"]


def test_proxy_export_tab_separated(spark, tmp_path):
    f = tmp_path / "export.tsv"
    f.write_text("用户名\t访问域名\t时间\nli\ta.org\t2026-07-22 10:00:00\n", encoding="utf-8")
    assert rows(S.read_proxy_export(spark, str(f)), "employee_id", "domain") == [("li", "a.org")]
    empty = tmp_path / "other.csv"
    empty.write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no header line in"):
        S.read_proxy_export(spark, str(empty)).collect()


def test_proxy_exports_with_their_own_layouts(spark, tmp_path):
    """Other column order, other delimiter, a header far down: every file is read by its own."""
    (tmp_path / "a.csv").write_text("用户名,访问域名,时间\nli,a.org,2026-07-22 10:00:00\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("时间,用户名,序号,访问域名\n2026-07-22 11:00:00,wang,1,b.org\n", encoding="utf-8")
    (tmp_path / "c.tsv").write_text("report\n" * 80 + "访问域名\t时间\t用户名\nc.org\t2026-07-22 12:00:00\tzhao\n", encoding="utf-8")
    df = S.read_proxy_export(spark, str(tmp_path))
    assert rows(df, "employee_id", "domain", F.hour("occurred_at")) == [("li", "a.org", 10), ("wang", "b.org", 11), ("zhao", "c.org", 12)]


def test_endpoint_folder(spark, tmp_path):
    (tmp_path / "文档操作.csv").write_text(
        "类型,时间,计算机,源文件,文件大小,磁盘类型,应用程序\n复制,45000.5,AB-CD-li,a.xlsx,\"1,024 KB\",移动硬盘,excel.exe\n,45000.5,AB-CD-li,b.xlsx,1,硬盘,x\n", encoding="utf-8")
    (tmp_path / "网页浏览.csv").write_text("时间,计算机,网址,标题\n45000.5,AB-CD-li,https://www.Example.com/a,t\n45000.6,AB-CD-li,,t\n", encoding="utf-8")
    (tmp_path / "misc.csv").write_text("时间,计算机,搜索关键字\n45000.7,pc-9,网盘\n", encoding="utf-8")
    df = S.read_endpoint_dir(spark, str(tmp_path))
    assert rows(df, "category", "employee_id", "action", "target_value", "size_bytes") == [
        ("DOC", "li", "COPY", "a.xlsx", 1048576), ("SEARCH", "pc-9", "SEARCH", "网盘", 0),
        ("WEB", "li", "VISIT", "https://www.Example.com/a", 0)]
    assert rows(df.filter("category = 'DOC'"), "channel", "app") == [("USB", "excel.exe")]
    assert rows(df.filter("category = 'WEB'"), "domain") == [("example.com",)]


def test_canonical_replay(spark, tmp_path):
    f = tmp_path / "events.csv"
    f.write_text(",".join(S.REPLAY_COLUMNS) + "\n2026-07-22 02:30:00,li,pc,DOC,COPY,FILE,a.xlsx,20480000,200\n")
    assert rows(S.read_canonical_csv(spark, str(f)), "employee_id", "size_bytes", "count") == [("li", 20480000, 200)]


def parse_proxy(spark, *msgs):
    return M.parse_proxy_messages(spark.createDataFrame([(m,) for m in msgs], "msg string"))


def test_proxy_message_spellings(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    head = "<134>Aug 20 10:00:00 host tag: "
    tab = "\t".join(["2026-08-20 10:00:00", "li", "g", "192.0.2.1", "", "", "IT", "hq", "", "", "http://a.example/x", "-", "t", ""])
    df = parse_proxy(
        spark, head + "[record_time:2026-08-20 10:00:00][user:li(li)][app:old][app:IT][url:http://a.example/x][DNS:-]",
        head + "record_time=2026-08-20 10:00:00 user=li app=\"IT\" url=http://a.example/x", tab,
        head + "[user:li][url:-][DNS:www.b.example][app:IT]", head + "[user:li][url:-][DNS:-][app:Outlook]",
        head + "[user:][url:http://a.example]", head + "[user:li][url:-]")
    assert rows(df, "employee_id", "domain", "target_value", "site_class") == sorted(
        [("li", "a.example", "http://a.example/x", "IT")] * 3
        + [("li", "b.example", "www.b.example", "IT"), ("li", "Outlook", "Outlook", "Outlook")])


def agent(kind, **fields):
    return f"<134>1 2026-08-20T17:32:41Z 192.0.2.9 {vocab.AGENT_MARKER}.exe 9208 {kind} - \ufeff" + json.dumps(fields, ensure_ascii=False)


def test_agent_messages(spark):
    msgs = [
        agent("doc_log", DOC_TIME="2026-08-20 10:00:00", DOC_AGT_ID=7, DOC_SUBTYPE=9, DOC_SRC_PATH="C:\\Users\\li.corp\\a.txt", DOC_SRC_NAME="a.txt", DOC_DEST_DEVICE=1, DOC_FILE_SIZE=12),
        agent("url_log", URL_TIME="2026-08-20 10:05:00", URL_AGT_ID=7, URL_SITE="A.org", URL_URL="http://a.org/x"),
        agent("url_log", URL_TIME="2026-08-20 09:00:00", URL_AGT_ID=7, URL_SITE="A.org", URL_URL="http://a.org/y"),
        agent("keyword_search_log", KS_TIME="bad", KS_AGT_ID=8, KS_KEYWORD="k"),
        agent("url_log", URL_TIME="2026-08-20 10:05:00", URL_URL="http://a.org/noid"),
        agent("usb_log", USB_TIME="2026-08-20 10:05:00", USB_AGT_ID=7), "plain text"]
    raw = spark.createDataFrame(list(enumerate(msgs)), "event_id bigint, msg string")
    df = resolve_identity(M.parse_agent_messages(raw))
    assert rows(df, "event_id", "employee_id", "category", "action", F.coalesce("channel", F.lit("-"))) == [
        (0, "li", "DOC", "SEND", "NETWORK"), (1, "li", "WEB", "VISIT", "-"), (2, "AGENT:7", "WEB", "VISIT", "-"),
        (3, "AGENT:8", "SEARCH", "SEARCH", "-")]
    assert df.filter("occurred_at is null").count() == 1
    a, p = M.route_messages(raw)
    assert (a.count(), p.count()) == (6, 1)


def test_raw_log_backfill(spark):
    raw = spark.createDataFrame([(1, "[log_type:web][user:li][app:IT] " + "x" * 5000), (2, "agent text")], "msg_id int, msg string").withColumn("received_at", F.current_timestamp())
    fill = spark.createDataFrame([(2, "DOC", "wang", "excel")], "msg_id int, category string, employee_id string, app string")
    names = spark.createDataFrame([("li", "Li"), ("wang", "Wang")], "account string, name string")
    out = M.raw_log_rows(raw, names, fill)
    assert rows(out, "log_type", "user", "app", F.length("msg")) == [("agent-doc", "Wang", "excel", 10), ("web", "Li", "IT", 4000)]


def test_csv_report_has_bom_and_order(spark, make, tmp_path):
    alerts = spark.createDataFrame([("a", 60), ("b", 90)], "employee_id string, risk_score int")
    for c in ("scenario", "severity", "status", "summary"):
        alerts = alerts.withColumn(c, F.lit(c))
    K.export_alerts(alerts.withColumn("window_start", F.lit("2026-01-01").cast("timestamp_ntz")).coalesce(1), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    text = parts[0].read_text(encoding="utf-8")
    assert text.startswith("\ufeffemployee_id") and [p.read_text().splitlines()[1][0] for p in parts if len(p.read_text().splitlines()) > 1][0] == "b"


def test_events_are_stored_by_day_and_category(spark, make, tmp_path):
    df = make([{"at": "2026-07-22 09:00:00", "domain": "a.org"}, {"at": "2026-07-23 09:00:00", "category": "DOC", "action": "COPY", "target": "f"}])
    K.append_partitioned(df, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e")).filter("event_date = date'2026-07-22' and category = 'WEB'")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 1 and "PartitionFilters: [isnotnull(event_date" in plan
    K.append_verdicts(spark.createDataFrame([("v",)], "verdict_id string").withColumn("window_start", F.lit("2026-01-01").cast("timestamp_ntz")), str(tmp_path / "v"))
    assert (tmp_path / "v" / "window_date=2026-01-01").exists()


def test_profile_export_is_one_folder_per_person(spark, tmp_path):
    rep = spark.createDataFrame([("a", "alert", "t"), ("b", "verdict", "u")], "employee_id string, kind string, text string")
    K.export_profiles(rep, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").glob("employee_id=*")) == ["employee_id=a", "employee_id=b"]


def records_of(spark, path, max_bytes):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = S.physical_lines(spark, path)
        scan = S.scan_blocks(lines, vocab.PROXY_HEADERS, {"all": ("user", "time", "domain")})
        layouts = S.file_layouts(scan)
        found = S.read_records(lines, layouts, S.block_starts(scan)).select("cells")
        return lines.select("block").distinct().count(), sorted(tuple(r[0]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [37, 200, 1000, 10**8])
def test_records_across_split_borders(spark, tmp_path, size):
    """Quoted line ends, separators, doubled quotes and blank lines, cut into splits anywhere; some records span several."""
    import csv
    import io
    import random
    rnd = random.Random(size)
    table = [["访问域名", "用户名", "时间"]]
    for k in range(60):
        piece = lambda: "".join(rnd.choice(['a', '"', ",", "\n", "\n\n", '",', "b c"]) for _ in range(rnd.randint(0, 12)))
        table.append([f"d{k}.org", piece() + "x", "y" + piece() + "z" * rnd.choice([1, 90])])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(table)
    (tmp_path / "a.csv").write_text(out.getvalue(), encoding="utf-8")
    blocks, got = records_of(spark, str(tmp_path / "a.csv"), size)
    assert got == sorted(tuple(c.strip() for c in r) for r in table)
    assert blocks > (60 if size < 100 else 1)  # Spark cuts a small file by its cores, too


def test_lines_are_cut_once(spark, tmp_path):
    """What is read of an export comes from one written table of named cells: its plan reads no text again."""
    (tmp_path / "a.csv").write_text('report,,\n用户名,x,访问域名,时间\nli,,a.org,1\n用户名,x,访问域名,时间\n"wa\nng","","b,org","2"\nshort,\nwu,3\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('时间\t访问域名\t用户名\n4\tc.org\tlu\n', encoding="utf-8")
    found = S.read_exports(spark, str(tmp_path), vocab.PROXY_HEADERS, {"all": ("user", "time", "domain")}).rows
    assert rows(found, "user", "domain", "time") == [("li", "a.org", "1"), ("lu", "c.org", "4"), ("wa\nng", "b,org", "2"), ("wu", "", "")]
    assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_stray_quote_inside_a_cell_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('用户名,访问域名,时间\nli,5" disk.org,2026-07-22 10:00:00\nwang,"b"x.org,2026-07-22 10:00:00\n', encoding="utf-8")
    assert rows(S.read_proxy_export(spark, str(tmp_path / "a.csv")), "employee_id", "domain") == [("li", '5" disk.org'), ("wang", "bx.org")]


def test_unread_files_are_listed(spark, tmp_path):
    (tmp_path / "misc.csv").write_text("a,b\n1,2\n\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("时间,计算机,搜索关键字\n45000.7,pc-9,网盘\n", encoding="utf-8")
    found = S.read_endpoint_folder(spark, str(tmp_path))
    assert [(r["file"].rsplit("/", 1)[1], r["n_lines"]) for r in found.unread.collect()] == [("misc.csv", 2)]
    assert found.rows.count() == 1
    (tmp_path / "网页.csv").write_text("x,y\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no header line in"):
        S.read_endpoint_dir(spark, str(tmp_path))
