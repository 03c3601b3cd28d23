"""Log messages of both feeds: routing, parsing, raw capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import domains as D
from ..functions import events as E
from ..functions import parsing as P
from ..functions.base import blank_to_null, choose, text

AGENT_HEAD = r"(?s)^<\d+>\d+\s+\S+\s+\S+\s+\S+\s+\d+\s+(\S+)\s+-\s+"


def route_messages(raw: DataFrame, msg: str = "msg") -> tuple[DataFrame, DataFrame]:
    """(agent, proxy) messages.  The agent marker is tested first: the proxy format accepts almost anything."""
    is_agent = F.coalesce(F.col(msg).contains(vocab.AGENT_MARKER), F.lit(False))
    return raw.filter(is_agent), raw.filter(~is_agent)


def proxy_fields(msg: str = "msg") -> Column:
    """Field map of a proxy message in any of its three spellings; of a repeated key the last counts."""
    t = F.trim(F.regexp_replace(F.trim(text(msg)), r"^<\d+>", ""))
    t = F.trim(F.regexp_replace(t, r"^\w{3}\s+\d+\s+\d+:\d+:\d+\s+\S+\s+\S+:\s*", ""))

    def pairs(pattern: str, clean) -> Column:
        lit = F.lit(pattern)
        return F.map_from_arrays(F.regexp_extract_all(t, lit, F.lit(1)),
                                 F.transform(F.regexp_extract_all(t, lit, F.lit(2)), clean))

    cells = F.when(t.contains("\t"), F.split(t, "\t")).otherwise(F.split(t, r"\s+"))
    names = F.array(*[F.lit(n) for n in vocab.PROXY_MESSAGE_FIELDS])
    n = F.least(F.size(cells), F.size(names))
    positional = F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(cells, F.lit(1), n))
    bracketed = t.contains("[") & t.contains("]")
    assigned = t.contains("=") & (t.contains("record_time=") | t.contains("user="))
    return (F.when(bracketed, pairs(r"\[(\w+):([^\]]*)\]", lambda x: F.trim(x)))
            .when(assigned, pairs(r"(\w+)=(.*?)(?=\s+\w+=|$)",
                                  lambda x: F.regexp_replace(F.trim(x), r'^"+|"+$', "")))
            .otherwise(positional))


def parse_proxy_messages(raw: DataFrame, msg: str = "msg") -> DataFrame:
    """Canonical WEB rows; without person, or without URL, application and DNS name a message gives nothing."""
    def field(name: str) -> Column:
        return text(F.try_element_at(F.col("f"), F.lit(name)))

    r = raw.withColumn("f", proxy_fields(msg)).withColumn("person", P.clean_user(field("user")))
    r = r.withColumn("u", F.trim(field("url"))).withColumn("a", F.trim(field("app"))).withColumn("d", F.trim(field("DNS")))
    no_url = F.col("u").isin("", "-")
    r = r.filter((F.col("person") != "") & ~(no_url & (F.col("a") == "") & (F.col("d") == "")))
    named = ~F.col("d").isin("", "-")
    target = F.when(~no_url, F.col("u")).when(named, F.col("d")).otherwise(F.col("a"))
    domain = F.when(~no_url, D.url_domain("u")).when(named, D.url_domain("d")).otherwise(F.col("a"))
    keep = ["group", "host_ip", "dst_ip", "serv", "net_action", "keyword_original"]
    others = [c for c in raw.columns if c != msg]
    e = r.select(
        *others, P.parse_time(field("record_time")).alias("occurred_at"), F.col("person").alias("employee_id"),
        field("host_ip").alias("device_id"), F.lit("WEB").alias("category"), F.lit("VISIT").alias("action"),
        F.lit("URL").alias("target_type"), target.alias("target_value"), F.lit(0).cast("bigint").alias("size_bytes"),
        F.lit(1).alias("count"), F.lit("proxy").alias("source"), domain.alias("domain"), target.alias("url"),
        field("title").alias("title"), F.col("a").alias("app"),
        F.coalesce(blank_to_null(field("app")), field("site")).alias("site_class"),
        field("keyword_original").alias("raw_keyword"),
        F.create_map(*[x for k in keep for x in (F.lit(k), field(k))]).alias("raw"))
    return e.withColumn("event_hash", E.event_hash())


def parse_agent_messages(raw: DataFrame, msg: str = "msg") -> DataFrame:
    """Rows of web, search and document agent messages with the ids needed to resolve the person.

    Other kinds and messages without agent and user id give nothing; an
    unreadable time stays null for quarantine.
    """
    r = (raw.filter(F.col(msg).contains(vocab.AGENT_MARKER))
         .withColumn("kind", F.regexp_extract(F.col(msg), AGENT_HEAD, 1)).filter("kind <> ''")
         .withColumn("f", F.from_json(F.regexp_extract(F.col(msg), r"(?s)\{.*", 0), "map<string,string>"))
         .filter("f is not null"))

    def field(name) -> Column:
        return F.try_element_at(F.col("f"), F.lit(name) if isinstance(name, str) else name)

    probed = F.coalesce(*[F.when(field(f"{p}_TIME").isNotNull() | field(f"{p}_CLT_TIME").isNotNull(), F.lit(p))
                          for p in vocab.AGENT_PROBE_PREFIXES])
    r = r.withColumn("p", F.coalesce(choose("kind", vocab.AGENT_KINDS), probed))
    own = lambda name: field(F.concat("p", F.lit("_" + name)))
    f = lambda name: text(field(name))
    web, search, doc = [F.col("kind") == k for k in ("url_log", "keyword_search_log", "doc_log")]
    action = P.doc_subtype_action(f("DOC_SUBTYPE"))
    channel = P.device_channel(f("DOC_DEST_DEVICE"))
    channel = F.when((action == "SEND") & (channel == "LOCAL"), "NETWORK").otherwise(channel)
    site = F.coalesce(blank_to_null(F.lower(f("URL_SITE"))), f("URL_URL"))
    null = F.lit(None).cast("string")
    others = [c for c in raw.columns if c != msg]
    event = F.struct(*[c.alias(name) for name, c in {
        "occurred_at": F.try_to_timestamp(F.coalesce(own("TIME"), own("CLT_TIME")),
                                          F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"),
        "agent_id": text(own("AGT_ID")), "user_no": text(own("USR_ID")), "device_id": text(own("AGT_ID")),
        "account_hint": F.when(doc, P.account_from_path(f("DOC_SRC_PATH"), f("DOC_DEST_PATH"))),
        "category": F.when(web, "WEB").when(search, "SEARCH").otherwise("DOC"),
        "action": F.when(web, "VISIT").when(search, "SEARCH").otherwise(action),
        "target_type": F.when(web, "URL").when(search, "KEYWORD").otherwise("FILE"),
        "target_value": F.when(web, F.coalesce(blank_to_null(f("URL_URL")), site)).when(search, f("KS_KEYWORD"))
        .otherwise(F.coalesce(blank_to_null(f("DOC_SRC_NAME")), f("DOC_SRC_PATH"))),
        "size_bytes": F.when(doc, F.coalesce(f("DOC_FILE_SIZE").try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)),
        "count": F.lit(1), "source": F.lit("endpoint"),
        "domain": F.when(web, site).when(search, F.lower(f("KS_SITE"))).otherwise(null),
        "url": F.when(web, f("URL_URL")).otherwise(null),
        "title": F.when(web, f("URL_APP_TITLE")).when(search, f("KS_APP_TITLE")).otherwise(null),
        "app": F.when(web, f("URL_APP_NAME")).when(search, f("KS_APP_NAME")).otherwise(f("DOC_APP_NAME")),
        "channel": F.when(doc, channel).otherwise(null),
        "src_path": F.when(doc, F.substring(f("DOC_SRC_PATH"), 1, 400)).otherwise(null),
        "dest_path": F.when(doc, F.substring(f("DOC_DEST_PATH"), 1, 400)).otherwise(null),
    }.items()])
    known = (web | search | doc) & ((text(own("AGT_ID")) != "") | (text(own("USR_ID")) != ""))
    # A message is zero or one event.  The explode also keeps later filters and join keys from being
    # rewritten in terms of the JSON expressions.
    return (r.select(*others, F.explode(F.when(known, F.array(event))).alias("e")).select(*others, "e.*"))


def raw_log_rows(raw: DataFrame, aliases: DataFrame | None = None, agent_rows: DataFrame | None = None) -> DataFrame:
    """(received_at, log_type, user, app, msg) of messages for later inspection.

    `agent_rows` (msg_id, category, employee_id, app) back-fills agent messages,
    which carry no bracketed fields; then `raw` needs `msg_id`.
    """
    def tag(name: str) -> Column:
        return F.trim(F.regexp_extract(text("msg"), rf"\[{name}:([^\]]+)\]", 1))

    out = raw.withColumn("log_type", tag("log_type")).withColumn("user", tag("user")).withColumn("app", tag("app"))
    if agent_rows is not None:
        fill = agent_rows.select("msg_id", F.concat(F.lit("agent-"), F.lower("category")).alias("_t"),
                                 F.col("employee_id").alias("_u"), F.col("app").alias("_a"))
        out = out.join(fill, "msg_id", "left")
        empty = F.col("user") == ""
        out = (out.withColumn("log_type", F.when(empty, F.coalesce("_t", "log_type")).otherwise(F.col("log_type")))
               .withColumn("app", F.when(empty, F.coalesce("_a", "app")).otherwise(F.col("app")))
               .withColumn("user", F.when(empty, F.coalesce("_u", "user")).otherwise(F.col("user"))))
    if aliases is not None:
        names = aliases.select(F.col("account").alias("user"), F.col("name").alias("_name"))
        out = out.join(names, "user", "left").withColumn("user", F.coalesce("_name", "user"))
    return out.select("received_at", "log_type", "user", "app", F.substring("msg", 1, 4000).alias("msg"))


def read_raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """Messages from text files as they arrive, with receive time."""
    return (spark.readStream.format("text").option("wholetext", False).load(path)
            .select(F.col("value").alias("msg"), F.current_timestamp().alias("received_at")))


def read_raw_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from a Kafka topic, where the connector is on the class path."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
            .select(F.col("value").cast("string").alias("msg"), F.col("timestamp").alias("received_at")))
