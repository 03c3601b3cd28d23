import pytest
from pyspark.sql import functions as F

from tidewatch.functions import domains as D
from tidewatch.functions import events as E
from tidewatch.functions import parsing as P
from tidewatch.vocab import DEFAULT, Vocabulary


def one(spark, column, x="", y=""):
    return spark.createDataFrame([(x, y)], "x string, y string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("1,024 KB", 1048576), ("1.5 MB", 1572864), ("12", 12), ("12 apples", 12), ("", 0), ("0", 0), ("x KB", 0),
    ("nan", 0), ("inf", 0), ("2 Bytes", 2)])
def test_parse_size(spark, text, expected):
    assert one(spark, P.parse_size("x"), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("2026-08-20 10:00:01", "2026-08-20 10:00:01"), ("2026/8/2 9:05", "2026-08-02 09:05:00"), ("soon", None), ("", None)])
def test_parse_time(spark, text, expected):
    got = one(spark, P.parse_time("x"), text)
    assert (str(got) if got else None) == expected


def test_excel_serial(spark):
    assert str(one(spark, P.excel_serial_ts("x"), "45000.5")) == "2023-03-15 12:00:00"
    assert str(one(spark, P.excel_serial_ts("x"), "2024-01-02 03:04:05")) == "2024-01-02 03:04:05"
    assert one(spark, P.excel_serial_ts("x"), "bad") is None


@pytest.mark.parametrize("url,expected", [
    ("https://www.Example.com/a", "example.com"), ("a_b.example.com:8080/x?y", "a_b.example.com:8080"),
    ("http://u:p@h.org", "u:p@h.org"), ("", "")])
def test_url_domain(spark, url, expected):
    assert one(spark, D.url_domain("x"), url) == expected


@pytest.mark.parametrize("domain,expected", [
    ("mail.qq.com", "personal_email"), ("exmail.qq.com", None), ("a.mail.qq.com", "personal_email"),
    ("authds.todesk.com", "remote_control"), ("githubcopilot.com", "code_repo"), ("storage.live.com", None),
    ("X.Storage.Live.com", None), ("", None), ("linkedin.com.cdn.net", None), ("www.zhipin.com", "recruitment")])
def test_risk_class(spark, domain, expected):
    assert one(spark, D.risk_class("x"), domain) == expected


@pytest.mark.parametrize("domain,label,expected", [
    ("www.bilibili.com", "", "video"), ("weibo.com", "娱乐资讯", "news"), ("example.org", "网络视频", "video"),
    ("example.org", "视频会议", None), ("cdn.bilibili.com", "", None), ("api.bilibili.com", "", None), ("office.com", "", None)])
def test_leisure(spark, domain, label, expected):
    assert one(spark, D.leisure_class("x", "y"), domain, label) == expected


def test_noise(spark):
    assert one(spark, D.is_noise_web("x", "y"), "a.org", "https://a.org/x/app.js?v=1")
    assert not one(spark, D.is_noise_web("x", "y"), "a.org", "https://a.org")
    assert not one(spark, D.is_noise_web("x", "y"), "a.org", "a.js")
    assert one(spark, D.is_noise_web("x", "y"), "ocsp.digicert.com", "")


@pytest.mark.parametrize("score,expected", [(30, "LOW"), (31, "MEDIUM"), (56, "HIGH"), (76, "CRITICAL")])
def test_severity(spark, score, expected):
    assert spark.range(1).select(E.severity(F.lit(score)).alias("r")).first()["r"] == expected


@pytest.mark.parametrize("scenario,score,expected", [
    ("data_exfiltration", 70, 75), ("data_exfiltration", 95, 90), ("job_seeking", 56, 60), ("other", 33, 33)])
def test_snap_tier(spark, scenario, score, expected):
    assert spark.range(1).select(E.snap_tier(F.lit(scenario), F.lit(score)).alias("r")).first()["r"] == expected


def test_event_hash_matches_hashlib(spark):
    import datetime as dt
    import hashlib
    for at in (dt.datetime(2026, 7, 22, 2, 30), dt.datetime(2026, 7, 22, 2, 30, 1, 5)):
        df = spark.createDataFrame([(at, "p", "DOC", "COPY", "f")], "occurred_at timestamp_ntz, employee_id string, category string, action string, target_value string")
        want = hashlib.sha256("|".join([at.isoformat(), "p", "DOC", "COPY", "f"]).encode()).hexdigest()
        assert df.select(E.event_hash().alias("h")).first()["h"] == want


def test_accounts(spark):
    assert one(spark, P.clean_user("x"), "li(li)") == "li"
    assert one(spark, P.clean_user("x"), "li (ops)") == "li"
    assert one(spark, P.clean_account("x"), "Li.corp.001") == "li"
    assert one(spark, P.account_from_path("x", "y"), "", r"C:\Users\wang\a.txt") == "wang"
    assert one(spark, P.normalize_user("x"), "DOM\\wang") == "wang"
    assert one(spark, P.person_from_host("x"), "AB-CD-wang") == "wang"


def test_vocabulary_overrides():
    v = DEFAULT.with_overrides([("netdisk_domains", "", "disk.example"), ("slack_domains", "video", "x.example"),
                                ("slack_domains", "forum", "f.example")])
    assert "disk.example" in v.get("netdisk_domains") and "pan.baidu.com" in v.get("netdisk_domains")
    assert "x.example" not in v.categories["slack_domains"]["video"]
    assert v.categories["slack_domains"]["forum"] == ["f.example"]
    with pytest.raises(ValueError):
        Vocabulary(limit=3)
