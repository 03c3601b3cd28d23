"""Scalar functions over text derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import events as E
from ..functions import parsing as P
from ..functions.base import fmt_ts
from .base import *

K = "cast({json}(props, '$.k') as int)"


def derived(name: str, source_sql: str, column, result_sql: str, out: str = "result", key: str = "event_id",
            table: str = "events", **more):
    """Register one function: `source_sql` makes the input column `x` in both engines, `column()` is the result."""
    body = f"select {key}, {source_sql} as x from {{t}}"
    spark_sql = body.replace("{json}", "get_json_object").replace("\\", "\\\\")
    duck = body.replace("{json}", "json_extract_string").replace("{t}", table)

    @register(name, f"select {key}, x, {result_sql} as {out} from ({duck})")
    def run(spark, sf):
        src = spark.sql(spark_sql, t=read_table(spark, sf, table))
        return src.select(key, "x", column().alias(out))
    return run


derived("f01_excel_serial_ts", f"concat(cast(45000 + event_id % 400 as string), '.', {K})", lambda: P.excel_serial_ts("x"),
        "timestamp '1899-12-30 00:00:00' + to_microseconds(cast(round(cast(x as double) * 86400000000) as bigint))")
derived("f02_parse_size", f"concat(case when {K} % 4 = 0 then '1,' else '' end, cast(100 + {K} as string), '.5', case {K} % 5 when 0 then ' KB' when 1 then ' mb' when 2 then ' GB' when 3 then ' zz' else '' end)",
        lambda: P.parse_size("x"),
        """cast(trunc(cast(regexp_extract(replace(x, ',', ''), '^[0-9.]+') as double) * case upper(split_part(x, ' ', 2)) when 'KB' then 1024 when 'MB' then 1048576 when 'GB' then 1073741824 when 'TB' then 1099511627776 else 1 end) as bigint)""")
derived("f03_normalize_user", f"concat(case when {K} % 2 = 0 then 'DOM\\' else '' end, ' u', user_id)", lambda: P.normalize_user("x"),
        r"split_part(trim(x), '\', -1)")
derived("f04_disk_channel", f"case {K} % 6 when 0 then '本地硬盘' when 1 then '移动硬盘' when 2 then '网络共享' when 3 then 'usb key' when 4 then '' else '光盘' end",
        lambda: P.disk_channel("x"),
        "case when trim(x) in ('', '硬盘', '本地盘', '本地硬盘') then 'LOCAL' when contains(x, '移动') or contains(x, 'U盘') or contains(upper(x), 'USB') then 'USB' when contains(x, '网络') or contains(x, '网盘') or contains(x, '共享') then 'NETWORK' else 'OTHER' end")
derived("f05_url_domain", "case page_id % 3 when 0 then url when 1 then concat(split_part(url, '://', 2)) else concat('HTTP://u:p@WWW.', split_part(url, '://', 2)) end",
        lambda: D.url_domain("x"), "regexp_replace(lower(regexp_extract(case when contains(x, '://') then x else 'http://' || x end, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '')",
        key="page_id", table="pages")
derived("f06_domain_class", f"concat('a', {K}, case {K} % 5 when 0 then '.pan.baidu.com' when 1 then '.gmail.com.cdn.net' when 2 then '.zhaopin.net' when 3 then '.Dropbox.com' else '.example.org' end)",
        lambda: D.domain_class("x"),
        f"case when {sql_contains('lower(x)', V.get('netdisk_domains'))} then 'netdisk' when {sql_contains('lower(x)', V.get('personal_email_domains'))} then 'personal_email' when {sql_contains('lower(x)', V.get('recruitment_sites'))} then 'recruitment' else 'other' end")
derived("f07_person_from_host", f"concat(case {K} % 3 when 0 then 'AB-CD-' when 1 then 'ab-CD-' else '' end, 'u', user_id)", lambda: P.person_from_host("x"),
        "case when regexp_matches(x, '^[A-Z]+-[A-Z]+-.+$') then regexp_extract(x, '^[A-Z]+-[A-Z]+-(.+)$', 1) else x end")
derived("f08_doc_action", f"case {K} % 7 when 0 then '复制' when 1 then '打开' when 2 then '另存为' when 3 then '发送' when 4 then '刻录' when 5 then ' 删除' else '未知' end",
        lambda: P.doc_action("x"),
        "case trim(x) " + " ".join(f"when {q(k)} then {q(v)}" for k, v in vocab.DOC_ACTIONS.items()) + " else 'UNKNOWN' end")
derived("f09_clean_user", f"concat(' u', user_id, case {K} % 3 when 0 then concat('(u', user_id, ')') when 1 then ' (ops)' else '' end)", lambda: P.clean_user("x"),
        r"trim(regexp_replace(trim(x), '\([^)]*\)$', ''))")
derived("f10_parse_time", f"case {K} % 5 when 0 then concat('2024-01-', 1 + {K} % 28, ' 8:05:09') when 1 then concat('2024/1/', 1 + {K} % 28, ' 23:59:59') when 2 then concat('2024-01-', 1 + {K} % 28, ' 08:05') when 3 then concat('2024/01/', 1 + {K} % 28, ' 8:05') else 'n/a' end",
        lambda: P.parse_time("x"),
        "coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y/%m/%d %H:%M:%S'), try_strptime(x, '%Y-%m-%d %H:%M'), try_strptime(x, '%Y/%m/%d %H:%M'))")
derived("f11_clean_account", f"concat('U', user_id, case {K} % 4 when 0 then '.corp.001' when 1 then '.Example' when 2 then '.x.local' else '' end)", lambda: P.clean_account("x"),
        r"regexp_replace(regexp_replace(lower(x), '\.(corp|example|local)\.\d+$', ''), '(\.(corp|example|local))+$', '')")
derived("f12_account_from_path", f"case {K} % 3 when 0 then concat('C:\\Users\\u', user_id, '\\Desktop\\a.txt') when 1 then concat('/home/users/u', user_id, '/a.txt') else 'D:\\data\\a.txt' end",
        lambda: P.account_from_path("x", "x"), r"nullif(regexp_extract(x, '[Uu]sers[\\/]+([^\\/]+)[\\/]', 1), '')")
derived("f13_doc_subtype", f"cast({K} % 25 as string)", lambda: F.concat_ws("/", P.doc_subtype_action("x"), P.device_channel("x")),
        "(case x " + " ".join(f"when {q(k)} then {q(v)}" for k, v in vocab.DOC_SUBTYPES.items()) + " else 'OPEN' end) || '/' || case x when '5' then 'NETWORK' else 'LOCAL' end")
derived("f17_is_noise_doc", f"concat(case {K} % 4 when 0 then 'C:\\Users\\a\\AppData\\' when 1 then 'D:\\work\\' when 2 then '/data/.Cache/' else 'C:\\Windows\\' end, 'f', {K})",
        lambda: E.is_noise_doc(F.lit("DOC"), F.lit("DELETE"), F.col("x"), F.lit("name.txt")), sql_contains("lower(x)", vocab.NOISE_PATHS))
derived("f15_severity", f"{K}", lambda: E.severity("x"), "case when x >= 76 then 'CRITICAL' when x >= 56 then 'HIGH' when x >= 31 then 'MEDIUM' else 'LOW' end")
derived("f16_is_noise_web", f"concat('https://', case {K} % 4 when 0 then 'ocsp.x.com' when 1 then 'www.google.com' else 'a.example.org' end, case {K} % 6 when 0 then '/s/app.js?v=1' when 1 then '/i/logo.PNG' when 2 then '/q?f=a.css' else '/page' end)",
        lambda: D.is_noise_web(D.url_domain("x"), F.col("x")),
        f"{sql_contains('lower(x)', ['ocsp.', 'google.'])} or regexp_matches(lower(x), '^https://[^/]*/[^?]*\\.(" + "|".join(vocab.NOISE_EXTENSIONS) + ")(\\?.*)?$')")
derived("f18_match_domain", f"concat(case {K} % 3 when 0 then '' when 1 then 'a.' else 'ex' end, case {K} % 2 when 0 then 'mail.qq.com' else 'todesk.net' end)",
        lambda: D.match_domain("x", ["mail.qq.com", "todesk"]), "x = 'mail.qq.com' or ends_with(x, '.mail.qq.com') or contains(x, 'todesk')")
HOST = f"concat(case {K} % 4 when 0 then '' when 1 then 'www.' when 2 then 'a.b.' else 'my' end, case {K} % 11 when 0 then 'pan.baidu.com' when 1 then 'mail.qq.com' when 2 then 'zhipin.com' when 3 then 'githubcopilot.com' when 4 then 'todesk.com' when 5 then 'storage.live.com' when 6 then 'deepseek.com' when 7 then 'filehelper.weixin.qq.com' when 8 then 'office.com' when 9 then 'bilibili.com' else 'example.org' end)"
derived("f19_risk_class", HOST, lambda: D.risk_class("x"), sql_risk("x"))
derived("f20_risk_tier", HOST, lambda: D.risk_tier(D.risk_class("x")), TIER.format(c=f"({sql_risk('x')})"))
derived("f21_is_heartbeat", f"concat(case {K} % 3 when 0 then 'authds.' when 1 then 'auth2.' else 'www.' end, case {K} % 2 when 0 then 'todesk.com' else 'example.org' end)",
        lambda: D.is_heartbeat("x", D.risk_class("x")), "contains(x, 'todesk') and starts_with(x, 'auth')")
derived("f22_leisure_class", HOST, lambda: D.leisure_class("x", F.when(F.col("event_id") % 3 == 0, "网络视频").when(F.col("event_id") % 3 == 1, "视频会议").otherwise("")),
        sql_leisure("x", "(case event_id % 3 when 0 then '网络视频' when 1 then '视频会议' else '' end)"))
derived("f23_work_domain", HOST, lambda: D.is_work_domain("x"), sql_suffix("x", V.get("work_domains")))
derived("f24_sensitive_risky", f"concat(case {K} % 5 when 0 then '合同' when 1 then 'offer letter' when 2 then '数据恢复' when 3 then 'resume' else '' end, ' f', {K})",
        lambda: F.concat_ws("/", E.is_sensitive("x").cast("string"), E.search_risky("x").cast("string")),
        f"({sql_contains('x', V.get('sensitive_keywords'))})::varchar || '/' || ({sql_contains('x', RISKY_TERMS)})::varchar")
derived("f25_time_of_day", "ts", lambda: F.concat_ws("/", E.is_off_hours("x").cast("string"), E.is_work_hours("x").cast("string")),
        f"({OFF.format(t='x')})::varchar || '/' || ({WORK.format(t='x')})::varchar")
derived("f26_person_kinds", f"case {K} % 6 when 0 then concat('10.0.0.', {K}) when 1 then concat('aa:bb:cc:dd:ee:', 10 + {K} % 80) when 2 then cast(user_id as string) when 3 then concat('1380000', 1000 + user_id) when 4 then concat('林', user_id) else concat('u', user_id) end",
        lambda: F.concat_ws("/", *[c.cast("string") for c in (E.is_ip("x"), E.is_person("x"), E.is_visitor("x"), E.is_visitor("x", 8), E.is_named("x"))]),
        r"""concat_ws('/', regexp_matches(x, '^\d{1,3}(\.\d{1,3}){3}$')::varchar, (x <> '' and not regexp_matches(x, '^\d{1,3}(\.\d{1,3}){3}$') and not regexp_matches(x, '^[0-9a-fA-F]{2}([:-][0-9a-fA-F]{2}){5}$'))::varchar,
        regexp_matches(x, '^\d+$')::varchar, regexp_matches(x, '^\d{8,}$')::varchar, contains(x, '林')::varchar)""")
derived("f27_dest_root", f"case {K} % 4 when 0 then 'A.Storage.Live.com/x/y' when 1 then 'wetransfer.com/up' when 2 then 'teams.microsoft.com' else '' end",
        lambda: F.concat_ws("/", D.dest_root("x"), D.is_whitelisted_dest("x").cast("string")),
        f"lower(split_part(x, '/', 1)) || '/' || ({sql_suffix(chr(108) + 'ower(split_part(x, ' + chr(39) + '/' + chr(39) + ', 1))', WHITE)})::varchar")
derived("f28_app_context", f"case {K} % 6 when 0 then 'WeChat.exe' when 1 then 'msedge.exe' when 2 then 'EXCEL.EXE' when 3 then 'explorer.exe' when 4 then '' else 'other.exe' end",
        lambda: E.app_context("x"), "case when contains(lower(x), 'weixin') or contains(lower(x), 'wechat') then 'chat' when contains(lower(x), 'msedge') or contains(lower(x), 'chrome') then 'browser' when contains(lower(x), 'excel') then 'office' when contains(lower(x), 'explorer') then 'file_manager' else lower(x) end")
derived("f29_is_telemetry", f"concat(case {K} % 5 when 0 then 'st.' when 1 then 'Update-' when 2 then 'wss.' when 3 then 'best.' else '' end, 'x.com')",
        lambda: D.is_telemetry("x"), sql_prefix("lower(x)", vocab.TELEMETRY_PREFIXES))
derived("f30_file_parts", f"concat('PRJ-', {K}, ' QMS_1', {K}, ' AB-77 CD-88', case {K} % 3 when 0 then '.XLSX' when 1 then '' else '.tar.gz' end)",
        lambda: F.concat_ws("/", F.coalesce(P.file_ext("x"), F.lit("-")), F.array_join(P.project_codes("x"), ",")),
        r"coalesce(nullif(lower(regexp_extract(x, '\.([A-Za-z0-9]{1,6})$', 1)), ''), '-') || '/' || array_to_string(regexp_extract_all(x, '[A-Z]{2,6}[-_][0-9]{2,6}')[1:3], ',')")
derived("f31_json_text", "props", lambda: P.json_text("x", "k"), "json_extract_string(x, '$.k')")
derived("f32_snap_tier", f"{K}", lambda: E.snap_tier(F.when(F.col("event_id") % 3 == 0, "job_seeking").when(F.col("event_id") % 3 == 1, "data_exfiltration").otherwise("other"), "x"),
        """case event_id % 3 when 0 then coalesce(list_min(list_filter([55,60,65,70,75,80,85,90,95], lambda t: t >= x)), 95)
        when 1 then coalesce(list_min(list_filter([75,80,85,90], lambda t: t >= x)), 90) else x end""")
derived("f33_account_key", f"concat('Li.Wei_', user_id, '-', {K})", lambda: P.account_key("x"), r"regexp_replace(regexp_replace(lower(x), '[._-]', '', 'g'), '\d+$', '')")
derived("f34_strip_site_prefix", f"concat(case {K} % 3 when 0 then 'HQ-BJ-' when 1 then 'ab-' else '' end, '林', user_id)", lambda: P.strip_site_prefix("x"),
        "trim(regexp_replace(x, '^[A-Za-z]{2,6}(-[A-Za-z]{2,6})+-', ''))")
derived("f35_time_bucket", "ts", lambda: E.time_bucket("x"), "time_bucket(interval 10 minute, x)")
derived("f38_day_bounds", "ts", lambda: F.concat_ws("/", fmt_ts(E.day("x"), "yyyy-MM-dd"), (F.col("x") >= E.day_start(AS_OF, 6)).cast("string")),
        f"cast(x as date)::varchar || '/' || (x >= cast(date '{AS_OF[:10]}' - 6 as timestamp))::varchar")
derived("f39_search_terms_from_url", f"concat('https://www.example.com/s?', case {K} % 3 when 0 then 'wd=' when 1 then 'p=1&q=' else 'z=' end, 'a%20b', {K}, '&t=2')",
        lambda: P.search_terms_from_url("x"), "replace(nullif(regexp_extract(x, '[?&](wd|q)=([^&]*)', 2), ''), '%20', ' ')")


@register("f14_event_hash", with_("canon", "select event_id, event_hash from canon"))
def f14(spark, sf):
    return ev(spark, sf).select("event_id", "event_hash")


# Model text is derived from events: reasoning block, code fence, broken JSON.
MODEL = """case event_id % 4 when 0 then concat('<think>a {x}</think>```json', chr(10), '{"intent": "job_seeking", "risk_score": ', cast(user_id % 100 as string), ', "channels": ["usb", "web"], "explanation": "e', event_id, '"}', chr(10), '```')
 when 1 then concat('thinking</think>result {"intent": "normal_work", "risk_score": "', cast(user_id % 100 as string), '", "deviation": "none"} done')
 when 2 then concat('broken "intent": "policy_violation", "deviation": "major" "risk_score": ', cast(user_id % 100 as string), ' "channels": ["a", ''b'']')
 else concat('no fields ', event_id) end"""


@register("f36_parse_model_output", f"""select event_id, case event_id % 4 when 0 then 'job_seeking' when 1 then 'normal_work' when 2 then 'policy_violation' end as intent,
 case event_id % 4 when 1 then 'none' when 2 then 'major' end as deviation, case event_id % 4 when 0 then 'e' || event_id end as explanation,
 case event_id % 4 when 0 then 'usb,web' when 2 then 'a,b' end as channels, case when event_id % 4 < 3 then (user_id % 100)::int end as risk_score from events""")
def f36(spark, sf):
    src = spark.sql("select event_id, " + MODEL.replace("{", "{{").replace("}", "}}") + " as t from {t}", t=read_table(spark, sf, "events"))
    m = P.parse_model_output("t")
    return src.select("event_id", m.alias("m")).select("event_id", "m.intent", "m.deviation", "m.explanation",
                                                       F.array_join("m.channels", ",").alias("channels"), "m.risk_score")


@register("f37_correct_counts", with_("wsite", """select employee_id, window_start, site, 'saw ' || site || '×' || visits || ' times' as result from wsite"""))
def f37(spark, sf):
    from ..operators.windows import shared_facts, window_sites
    sites = window_sites(shared_facts(ev(spark, sf)))
    claim = F.concat(F.lit("saw "), "site", F.lit("×"), (F.col("visits") + 7).cast("string"), F.lit(" times"))
    return sites.select("employee_id", "window_start", "site",
                        P.correct_counts(claim, F.create_map("site", "visits")).alias("result"))
