"""Canonical events derived from the generic `events` table.

The mapping is plain SQL that Spark and DuckDB both run; only the JSON accessor
differs, so one text serves the job and its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.events import event_hash

CANONICAL_SQL = """
select event_id, concat('u', user_id) as employee_id, concat('pc-', user_id % 40) as device_id, ts as occurred_at,
 category, action,
 case category when 'DOC' then 'FILE' when 'WEB' then 'URL' else 'KEYWORD' end as target_type,
 case category when 'DOC' then file_name when 'WEB' then domain else keyword end as target_value,
 cast(floor(value * 65536) as bigint) as size_bytes, cast(1 as int) as count,
 case when k % 10 < 5 and k % 2 = 0 then 'proxy' else 'endpoint' end as source,
 domain,
 case when category = 'WEB' then concat('https://', domain, case event_type when 'purchase' then '/upload/' when 'click' then '/send/' else '/page/' end, k) end as url,
 case when category = 'WEB' and k % 2 = 1 then concat('Page ', k) end as title,
 case when category = 'WEB' and k % 2 = 0 then null
      when k % 3 = 0 then 'chrome.exe' when k % 3 = 1 then 'WeChat.exe' else 'explorer.exe' end as app,
 case when category = 'WEB' and k % 2 = 0 then
   case k % 25 when 0 then '网络存储' when 2 then '求职招聘' when 14 then '娱乐资讯' else 'IT行业' end end as site_class,
 case when category = 'DOC' then case when action = 'SEND' then 'NETWORK' when k % 11 = 0 then 'USB' else 'LOCAL' end end as channel,
 case when category = 'DOC' then
   case when action = 'RENAME' then concat('D:\\work\\customer_list_final_', k, ext)
        when k % 20 = 5 then concat('C:\\Users\\u', user_id, '\\AppData\\Local\\', file_name)
        else concat('D:\\work\\', file_name) end end as src_path,
 case when action = 'RENAME' then concat('D:\\work\\', k, ext)
      when action = 'SEND' then case k % 3 when 0 then 'wetransfer.com/up' when 1 then 'teams.microsoft.com/f' else 'mail.163.com/a' end end as dest_path
from (
 select *, case when category = 'DOC' then concat(case k % 4 when 0 then 'PRJ-' when 1 then 'report_' when 2 then 'QMS-' else '合同_draft_' end, k, ext) end as file_name,
  case when category = 'SEARCH' then concat(case k when 9 then '简历模板 ' when 19 then 'offer ' when 29 then '网盘 ' else '' end, 'kw', k) end as keyword
 from (
  select *,
   case when k % 10 < 5 then 'WEB' when k % 10 < 9 then 'DOC' else 'SEARCH' end as category,
   case when k % 10 < 5 then 'VISIT' when k % 10 = 9 then 'SEARCH'
        when event_type = 'view' then 'READ' when event_type = 'click' then 'ARCHIVE' when event_type = 'signup' then 'RENAME'
        when event_type = 'purchase' then 'SEND' else 'DELETE' end as action,
   case k % 3 when 0 then '.xlsx' when 1 then '.pdf' else '.zip' end as ext
  from (select *, cast({json}(props, '$.k') as int) as k from {events})
 )
) left join (values (0, 'pan.baidu.com'), (1, 'mail.qq.com'), (2, 'www.zhipin.com'), (3, 'maimai.cn'), (4, 'authds.todesk.com'),
 (5, 'ocsp.digicert.com'), (6, 'ocsp.digicert.com'), (7, 'ocsp.digicert.com'), (8, 'ocsp.digicert.com'), (9, 'ocsp.digicert.com'),
 (10, 'github.com'), (11, 'chat.deepseek.com'), (12, 'szfilehelper.weixin.qq.com'), (13, 'www.bilibili.com'), (14, 'weibo.com'),
 (15, 'ocsp.digicert.com'), (16, 'ocsp.digicert.com'), (17, 'ocsp.digicert.com'), (18, 'ocsp.digicert.com'), (19, 'ocsp.digicert.com'),
 (20, 'storage.live.com'), (21, 'www.taobao.com'), (22, 'office.com'), (23, 'exmail.qq.com'), (24, 'ocsp.digicert.com')) as host(slot, domain)
 on slot = case when category = 'WEB' then k % 25 end
"""


def canonical_sql(engine: str, events: str) -> str:
    """The mapping in the dialect of `spark` or `duckdb`."""
    if engine == "spark":
        # Spark unescapes backslashes in literals.
        return CANONICAL_SQL.format(json="get_json_object", events=events).replace("\\", "\\\\")
    return CANONICAL_SQL.format(json="json_extract_string", events=events)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of a data folder, with `event_hash` and arrival order `event_id`."""
    sql = canonical_sql("spark", "{events}")
    return spark.sql(sql, events=read_table(spark, sf_dir, "events")).withColumn("event_hash", event_hash())
