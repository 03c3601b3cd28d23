import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tidewatch.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture(scope="session")
def make(spark):
    """Canonical events from short dicts; `at` is the time."""
    from tidewatch.functions.events import event_hash
    from tidewatch.schema import CANONICAL
    import datetime as dt

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            at = dt.datetime.fromisoformat(r["at"]) if isinstance(r["at"], str) else r["at"]
            cat = r.get("category", "WEB")
            full.append({
                "occurred_at": at, "employee_id": r.get("who", "p1"), "device_id": r.get("device", "d1"), "category": cat,
                "action": r.get("action", "VISIT" if cat == "WEB" else "SEARCH"), "target_type": "URL",
                "target_value": r.get("target", r.get("domain", "")), "size_bytes": r.get("size", 0),
                "count": r.get("count", 1), "source": r.get("source", "endpoint"), "domain": r.get("domain"),
                "url": r.get("url"), "title": r.get("title"), "app": r.get("app"), "site_class": r.get("site_class"),
                "channel": r.get("channel"), "src_path": r.get("src"), "dest_path": r.get("dest")})
        schema = T.StructType(CANONICAL.fields + [T.StructField("event_id", T.LongType())])
        df = spark.createDataFrame([tuple(x.get(f.name) for f in CANONICAL.fields) + (i,) for i, x in enumerate(full)], schema)
        return df.withColumn("event_hash", event_hash())
    return build
