"""Messages, identity, dictionaries and the ingest path."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocab
from ..functions.base import fmt_ts
from ..operators import classify as C
from ..operators import fold as FO
from ..operators import identity as ID
from ..operators import ingest as I
from ..session import cut_lineage
from ..sources import messages as M
from .base import *

HEAD = "<134>Aug 20 10:00:00 host tag: "


def proxy_messages(events):
    """Proxy rows rendered in the three spellings, with rows that must be dropped."""
    ts = fmt_ts("occurred_at")
    user = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat("employee_id", F.lit("("), "employee_id", F.lit(")")))
    url = F.when(F.col("event_id") % 5 == 0, "-").otherwise(F.col("url"))
    cells = [ts, user, F.lit("g1"), F.col("device_id"), F.lit("192.0.2.1"), F.lit("http"), F.col("site_class"), F.lit("hq"),
             F.lit("pc"), F.lit("allow"), url, F.col("domain"), F.lit("t"), F.lit("s")]
    names = vocab.PROXY_MESSAGE_FIELDS
    bracket = F.concat(F.lit(HEAD), *[F.concat(F.lit(f"[{n}:"), c, F.lit("]")) for n, c in zip(names, cells)], F.lit("[app:"), F.col("site_class"), F.lit("]"))
    assign = F.concat(F.lit(HEAD), F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), c) for n, c in zip(names, cells)]))
    kind = F.col("event_id") % 3
    return events.filter("source = 'proxy'").select("event_id", F.when(kind == 0, bracket).when(kind == 1, assign)
                                                    .otherwise(F.concat_ws("\t", *cells)).alias("msg"))


PROXY_BACK = """select event_id, date_trunc('second', occurred_at) as occurred_at, employee_id, device_id, case when event_id % 5 = 0 then domain else url end as target_value,
 regexp_replace(domain, '^www\\.', '') as domain, site_class from canon where source = 'proxy' and event_id % 7 <> 0"""


@register("s09_proxy_messages", with_("canon", PROXY_BACK))
def s09(spark, sf):
    return M.parse_proxy_messages(proxy_messages(ev(spark, sf))).select(
        "event_id", "occurred_at", "employee_id", "device_id", "target_value", "domain", "site_class")


def agent_messages(events):
    """Endpoint rows rendered as agent messages."""
    ts = fmt_ts("occurred_at")
    n = F.regexp_extract("device_id", r"(\d+)", 1)
    agent, user = F.concat(F.lit("A"), n), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("employee_id"))
    web = F.to_json(F.struct(ts.alias("URL_TIME"), agent.alias("URL_AGT_ID"), user.alias("URL_USR_ID"), F.upper("domain").alias("URL_SITE"),
                             F.col("url").alias("URL_URL"), F.col("app").alias("URL_APP_NAME"), F.col("title").alias("URL_APP_TITLE")))
    search = F.to_json(F.struct(ts.alias("KS_TIME"), agent.alias("KS_AGT_ID"), user.alias("KS_USR_ID"), F.col("target_value").alias("KS_KEYWORD"),
                                F.lit("S.example").alias("KS_SITE")))
    code = F.when(F.col("action") == "SEND", "9").when(F.col("action") == "DELETE", "6").when(F.col("action") == "RENAME", "4") \
        .when(F.col("action") == "ARCHIVE", "23").otherwise("7")
    doc = F.to_json(F.struct(ts.alias("DOC_TIME"), agent.alias("DOC_AGT_ID"), user.alias("DOC_USR_ID"), code.alias("DOC_SUBTYPE"),
                             F.col("src_path").alias("DOC_SRC_PATH"), F.col("target_value").alias("DOC_SRC_NAME"),
                             F.col("dest_path").alias("DOC_DEST_PATH"), F.lit(1).alias("DOC_DEST_DEVICE"), F.col("size_bytes").alias("DOC_FILE_SIZE")))
    kind = F.when(F.col("category") == "WEB", "url_log").when(F.col("category") == "DOC", "doc_log").otherwise("keyword_search_log")
    body = F.when(F.col("category") == "WEB", web).when(F.col("category") == "DOC", doc).otherwise(search)
    return events.filter("source = 'endpoint'").select("event_id", F.concat(
        F.lit("<134>1 2026-08-20T17:32:41Z 192.0.2.9 OTransLog.exe 9208 "), kind, F.lit(" - ﻿"), body).alias("msg"))


@register("s10_agent_messages", with_("canon", """select event_id, date_trunc('second', occurred_at) as occurred_at, 'A' || regexp_extract(device_id, '(\\d+)', 1) as agent_id, case when event_id % 3 = 0 then '' else employee_id end as user_no,
 category, action, case when category = 'WEB' then url else target_value end as target_value, case when category = 'DOC' then size_bytes else 0 end as size_bytes,
 case when category = 'WEB' then domain when category = 'SEARCH' then 's.example' end as domain, case when category = 'DOC' then case when action = 'SEND' then 'NETWORK' else 'LOCAL' end end as channel,
 case when category = 'DOC' then nullif(regexp_extract(src_path, '[Uu]sers[\\\\/]+([^\\\\/]+)[\\\\/]', 1), '') end as account_hint from canon where source = 'endpoint'"""))
def s10(spark, sf):
    return M.parse_agent_messages(agent_messages(ev(spark, sf))).select(
        "event_id", "occurred_at", "agent_id", "user_no", "category", "action", "target_value", "size_bytes", "domain", "channel", "account_hint")


@register("j03_resolve_identity", with_("canon", """select event_id, coalesce(acct, last_value(acct ignore nulls) over (partition by agent order by t, event_id rows unbounded preceding),
  case when user_no <> '' then last_value(acct ignore nulls) over (partition by user_no order by t, event_id rows unbounded preceding) end, 'AGENT:' || agent) as employee_id from
 (select event_id, date_trunc('second', occurred_at) as t, 'A' || regexp_extract(device_id, '(\\d+)', 1) as agent, case when event_id % 3 = 0 then '' else employee_id end as user_no,
  case when category = 'DOC' then nullif(lower(regexp_extract(src_path, '[Uu]sers[\\\\/]+([^\\\\/]+)[\\\\/]', 1)), '') end as acct from canon where source = 'endpoint')"""))
def j03(spark, sf):
    return ID.resolve_identity(cut_lineage(M.parse_agent_messages(agent_messages(ev(spark, sf))))).select("event_id", "employee_id")


def mixed_messages(events):
    return proxy_messages(events).unionByName(agent_messages(events))


@register("s08_route_messages", with_("canon", "select case when source = 'endpoint' then 'agent' else 'proxy' end as route, count(*) as n_rows from canon group by 1"))
def s08(spark, sf):
    agent, proxy = M.route_messages(mixed_messages(ev(spark, sf)))
    both = agent.select(F.lit("agent").alias("route")).unionByName(proxy.select(F.lit("proxy").alias("route")))
    return both.groupBy("route").agg(F.count("*").alias("n_rows"))


@register("s11_raw_log_rows", with_("canon", """select occurred_at as received_at, case when event_id % 3 = 0 then 'web_log' else '' end as log_type,
 case when event_id % 3 = 0 then case employee_id when 'u1' then '林一' when 'u2' then '林二' else employee_id end else '' end as "user", case when event_id % 3 = 0 then site_class else '' end as app, len(employee_id) > 0 as ok from canon where source = 'proxy'"""))
def s11(spark, sf):
    e = ev(spark, sf).filter("source = 'proxy'")
    msg = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[log_type:web_log][user:"), "employee_id", F.lit("][app:"), "site_class", F.lit("]")))
    raw = e.select(F.col("occurred_at").alias("received_at"), F.coalesce(msg, F.concat(F.lit("plain "), "employee_id")).alias("msg"))
    return M.raw_log_rows(raw, aliases(spark)).select("received_at", "log_type", "user", "app", (F.length("msg") > 0).alias("ok"))


STORED = """stored as (select distinct 'work_domains' as dict_name, '' as category, domain as pattern from canon where category = 'WEB' union select distinct 'slack_domains', 'forum', domain from canon where category = 'WEB' and source = 'proxy'
 union select distinct 'slack_domains', 'video', domain from canon where category = 'WEB')"""
DEFAULT_ROWS = "defaults as (select * from (values " + values([(n, c, p) for n, c, _, p in V.rows()]) + ") as x(dict_name, category, pattern))"


def stored_rows(events):
    web = events.filter("category = 'WEB'")
    row = lambda df, name, cat: df.select(F.lit(name).alias("dict_name"), F.lit(cat).alias("category"), F.col("domain").alias("pattern")).distinct()
    return (row(web, "work_domains", "").unionByName(row(web.filter("source = 'proxy'"), "slack_domains", "forum"))
            .unionByName(row(web, "slack_domains", "video")))


@register("s12_load_dictionaries", with_("canon", "").rstrip() + ", " + STORED + ", " + DEFAULT_ROWS + """ select * from defaults union select * from stored where dict_name = 'work_domains'
 union select s.* from stored s where dict_name = 'slack_domains' and category not in (select category from defaults where dict_name = 'slack_domains')""")
def s12(spark, sf):
    return C.merge_dictionary(C.dictionary_table(spark), stored_rows(ev(spark, sf)))


@register("l13_adopt_suggestions", with_("canon", "").rstrip() + ", " + STORED + """ select * from stored union select 'netdisk_domains', '', domain from canon where category = 'WEB'""")
def l13(spark, sf):
    from ..operators.alerts import adopt_suggestions
    e = ev(spark, sf)
    new = e.filter("category = 'WEB'").select(F.lit("netdisk_domains").alias("dict_name"), F.lit("").alias("category"), F.upper("domain").alias("pattern"))
    return adopt_suggestions(stored_rows(e), new)


@register("l16_replace_dictionary", with_("canon", "").rstrip() + ", " + STORED + """ select * from stored where dict_name <> 'work_domains' union all select distinct 'work_domains', '', domain from canon where source = 'proxy'""")
def l16(spark, sf):
    from ..operators.alerts import replace_dictionary
    e = ev(spark, sf)
    new = e.filter("source = 'proxy'").select(F.lit("work_domains").alias("dict_name"), F.lit("").alias("category"), F.col("domain").alias("pattern")).distinct()
    return replace_dictionary(stored_rows(e), "work_domains", new)


# ------------------------------------------------------------------ ingest path

@register("j02_resolve_aliases", with_("canon", f"""select event_id, emp as employee_id, {sql_hash(emp='emp')} as event_hash from (select *, case employee_id when 'u1' then '林一' when 'u2' then '林二' else employee_id end as emp from canon)"""))
def j02(spark, sf):
    return I.resolve_aliases(ev(spark, sf), aliases(spark)).select("event_id", "employee_id", "event_hash")


@register("j04_drop_cross_source", with_("canon", """select event_id from canon c where not (category = 'WEB' and source = 'endpoint' and exists (select 1 from canon p where p.category = 'WEB' and p.source = 'proxy'
 and p.employee_id = c.employee_id and p.domain = c.domain and abs(epoch_us(p.occurred_at) - epoch_us(c.occurred_at)) <= 86400000000))"""))
def j04(spark, sf):
    return I.drop_cross_source(ev(spark, sf), minutes=24 * 60).select("event_id")


@register("j04_covered_rows", """with e as (select event_id, user_id, event_type, ts from events) select event_id from e c where event_type = 'view' and exists (select 1 from e p where p.event_type = 'click' and p.user_id = c.user_id
 and abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 1800000000)""")
def j04_semi(spark, sf):
    e = read_table(spark, sf, "events")
    return I.near_in_time(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], 1800, ts="ts", how="semi").select("event_id")


@register("j05_stored_hashes", with_("canon", "select event_id from canon where occurred_at >= timestamp '2024-01-15'"))
def j05(spark, sf):
    e = ev(spark, sf)
    return e.join(e.filter("occurred_at < timestamp_ntz'2024-01-15'").select("event_hash"), "event_hash", "left_anti").select("event_id")


@register("k01_append_events", with_("canon", """select event_id, emp as employee_id from (select *, case when right(employee_id, 1) = '4' then substr(employee_id, 2) else employee_id end as emp from canon)
 where occurred_at >= timestamp '2024-01-15' and not regexp_matches(emp, '^[0-9]+$') and emp <> 'u9'"""))
def k01(spark, sf):
    e = ev(spark, sf)
    emp = F.when(F.right("employee_id", F.lit(1)) == "4", F.expr("substr(employee_id, 2)")).otherwise(F.col("employee_id"))
    new = e.withColumn("employee_id", emp)
    return I.append_events(new.unionByName(new), e.filter("occurred_at < timestamp_ntz'2024-01-15'"), ignored(spark)).select("event_id", "employee_id")


EMP = "case employee_id when 'u1' then '林一' when 'u2' then '林二' else employee_id end"
ONE_BATCH = f"""uniq as (select * from canon qualify row_number() over (partition by event_hash order by event_id) = 1),
 fold as (select employee_id, domain, time_bucket(interval 10 minute, occurred_at) as occurred_at, count(*)::int as n, arg_min(source, (occurred_at, event_hash)) as source
  from uniq where category = 'WEB' and not {sql_contains('lower(domain)', vocab.NOISE_HINTS)} group by 1, 2, 3),
 named as (select 'WEB' as category, {EMP} as emp, domain, occurred_at, n, source, 'VISIT' as action, domain as target_value from fold
  union all select category, {EMP}, domain, occurred_at, "count", source, action, target_value from uniq where category <> 'WEB'),
 kept as (select * from named c where not (category = 'WEB' and source = 'endpoint' and exists (select 1 from named p where p.category = 'WEB' and p.source <> 'endpoint'
  and p.emp = c.emp and lower(p.domain) = lower(c.domain) and p.domain <> '' and abs(epoch_us(p.occurred_at) - epoch_us(c.occurred_at)) <= 600000000)))"""


@register("t01_ingest_batches", with_("canon", "").rstrip() + ", " + ONE_BATCH + f""" select emp as employee_id, category, domain, occurred_at, n as n_visits, {sql_hash(emp='emp')} as event_hash
 from kept where not regexp_matches(emp, '^[0-9]+$') and emp <> 'u9'""")
def t01(spark, sf):
    """Three batches that cut through buckets and days, the first one sent twice, give the result of one batch."""
    return in_batches(spark, sf, lambda store: None)


def in_batches(spark, sf, between) -> DataFrame:
    from ..plans.pipeline import Store, ingest_batch
    from ..schema import CANONICAL
    from ..session import checkpoint_dir
    store = Store(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    e = stored_ev(spark, sf)
    for k in (0, 1, 2, 0):
        ingest_batch(store, e.filter(F.col("event_id") % 3 == k), k, aliases(spark), ignored(spark))
        between(store)
    return store.read("events", CANONICAL).select("employee_id", "category", "domain", "occurred_at", F.col("count").alias("n_visits"), "event_hash")


@register("t01_ingest_compacted", ORACLES["t01_ingest_batches"])
def t01_compacted(spark, sf):
    """The same with all days compacted after every batch, and the folders of replaced writes deleted."""
    from ..plans import live

    def tidy(store):
        live.compact_days(store.ledger())
        store.ledger().expire(live.TABLES)

    return in_batches(spark, sf, tidy)


@register("o4_message_union", with_("canon", "").rstrip() + """ select source, category, count(*) as n_rows from canon where source = 'endpoint' or event_id % 7 <> 0 group by 1, 2""")
def o4(spark, sf):
    from ..plans.pipeline import message_batch
    return message_batch(mixed_messages(ev(spark, sf))).groupBy("source", "category").agg(F.count("*").alias("n_rows"))


@register("k06_event_export", with_("canon", "select occurred_at, employee_id, device_id, category, action, target_value, size_bytes, channel, app as application, src_path as path from canon"))
def k06(spark, sf):
    from ..plans.reports import event_export
    return event_export(ev(spark, sf))


@register("l04_retention", with_("canon", f"select event_id from canon where occurred_at >= timestamp '{AS_OF}' - interval 20 day"))
def l04(spark, sf):
    return I.retain(ev(spark, sf), AS_OF, 20).select("event_id")


# ------------------------------------------------------------------ aliases

IDS = "case user_id % 6 when 0 then concat('Zhang.San_0', user_id % 3) when 1 then concat('li-si', user_id % 4) when 2 then concat('10.0.0.', user_id % 9) when 3 then '张三' when 4 then concat('HQ-BJ-', case user_id % 4 when 0 then '张三' else '赵六' end) else concat('guest', user_id % 5) end"
NAMES = [("张三", "zhangsan"), ("李四", "lisi"), ("李思", "lisi")]


@register("l10_discover_aliases", f"""with ids as (select distinct {IDS} as account from events), nk as (select * from (values {values(NAMES)}) as x(name, key)),
 keyed as (select account, regexp_replace(regexp_replace(lower(account), '[._-]', '', 'g'), '\\d+$', '') as key from ids where not regexp_matches(account, '[一-鿿]')),
 hit as (select account, count(distinct name) as c, min(name) as nm, string_agg(distinct name, ',' order by name) as ns from keyed join nk using (key) where not regexp_matches(account, '^\\d+(\\.\\d+){{3}}$') group by 1)
 select k.account, case when c = 1 then 'auto' when c > 1 then 'candidates' when regexp_matches(k.account, '^\\d+(\\.\\d+){{3}}$') then 'ignore_ip' else 'pending' end as state, case when c = 1 then nm end as name, case when c > 1 then ns end as candidates
 from keyed k left join hit using (account)
 union all select account, 'auto', regexp_replace(account, '^HQ-BJ-', ''), null from ids where starts_with(account, 'HQ-BJ-') and regexp_replace(account, '^HQ-BJ-', '') in (select account from ids)""")
def l10(spark, sf):
    ids = spark.sql(f"select distinct {IDS} as employee_id from {{t}}", t=read_table(spark, sf, "events"))
    return ID.discover_aliases(ids, spark.createDataFrame(NAMES, "name string, key string"))


@register("l15_review_aliases", """with acc as (select distinct concat('u', user_id) as account, user_id from events) select 'confirmed' as list, account, concat('n', user_id) as name from acc where user_id % 4 = 0 and user_id % 8 <> 4
 union all select 'pending', account, null from acc where user_id % 4 in (1, 3) and not (user_id % 4 = 1) union all select 'ignored', account, null from acc where user_id % 4 = 1""")
def l15(spark, sf):
    acc = read_table(spark, sf, "events").select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account")).distinct()
    name = F.concat(F.lit("n"), F.col("user_id").cast("string"))
    r = F.col("user_id") % 4
    confirmed = acc.filter(r == 0).select("account", name.alias("name"))
    pending = acc.filter(r.isin(1, 3)).select("account")
    ign = acc.filter(r == 2).select("account")
    actions = (acc.filter(F.col("user_id") % 8 == 4).select("account", F.lit("delete").alias("op"), F.lit("").alias("name"))
               .unionByName(acc.filter(r == 1).select("account", F.lit("ignore").alias("op"), F.lit("").alias("name")))
               .unionByName(acc.filter(r == 2).select("account", F.lit("undo").alias("op"), F.lit("").alias("name"))))
    out = ID.review_aliases(confirmed, pending, ign, actions)
    null = F.lit(None).cast("string")
    return (out["confirmed"].select(F.lit("confirmed").alias("list"), "account", "name")
            .unionByName(out["pending"].select(F.lit("pending").alias("list"), "account", null.alias("name")))
            .unionByName(out["ignored"].select(F.lit("ignored").alias("list"), "account", null.alias("name"))))
