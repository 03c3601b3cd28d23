"""Rule tables of any size against plain loops; repeats within components against one greedy pass."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import vocab
from tidewatch.operators import classify as C
from tidewatch.operators import matching as M
from tidewatch.operators import windows as W


def brute(rules, target, name):
    best = {}
    for family, t, how, pattern, rank, outcome in rules:
        if t == target and pattern and (name == pattern or name.endswith("." + pattern) if how == "suffix" else pattern in name):
            if family not in best or (rank, outcome or "") < (best[family][0], best[family][1] or ""):
                best[family] = (rank, outcome)
    return best


def test_matches_against_loops(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab.") for _ in range(rnd.randint(1, 7))).strip(".") or "a"
    rules = [(rnd.choice(["x", "y"]), rnd.choice(["host", "label"]), rnd.choice(["suffix", "anywhere"]), word(), rnd.randint(-1, 5), f"o{rnd.randint(0, 3)}") for _ in range(300)]
    names = [word() for _ in range(200)] + ["", "a" * 300, "文件.b", "b.文件夹"]
    rules += [("x", "host", "anywhere", "文件", 0, "cn"), ("x", "host", "suffix", "", 0, "none")]
    got = {(r["name"], r["family"]): (r["rank"], r["outcome"]) for r in M.matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rules, M.RULES), "host").collect()}
    want = {(n, f): x for n in set(names) if n for f, x in brute(rules, "host", n).items()}
    assert got == want and len(want) > 100


def test_large_dictionary_equals_literal_rules(spark, make):
    """20,000 entries more, some of which match; the default ones decide as the literal rules do."""
    hosts = [p for cats in vocab.DEFAULT_CATEGORIES.values() for ps in cats.values() for p in ps][:40]
    hosts += [p for d in vocab.DEFAULT_LISTS.values() for p in d if "." in p][:80]
    labels = [None, "网络视频", "企业视频会议", "游戏", "Teams", " 购物 "]
    rows = [{"at": "2026-07-22 09:00:00", "domain": prefix + h, "site_class": labels[k % len(labels)]} for k, h in enumerate(hosts) for prefix in ("", "www.", "cdn.", "x")]
    rows += [{"at": "2026-07-22 09:00:00", "domain": d} for d in ("site7.big.example", "no.site7.big.example", "site8.big.example", "k-needle13-k.org", "")]
    events = make(rows)
    more = [("netdisk_domains", "", f"site{k}.big.example") for k in range(0, 20_000, 2)] + [("work_domains", "", f"site{k}.big.example") for k in range(1, 20_000, 2)]
    more += [("recruitment_sites", "", f"needle{k}") for k in range(13, 14)] + [("slack_domains", "new", "site7.big.example")]
    entries = C.dictionary_table(spark).select("dict_name", "category", "pattern").unionByName(spark.createDataFrame(more, "dict_name string, category string, pattern string"))
    rules = M.dictionary_rules(entries).unionByName(M.label_rules(spark))
    got = {(r["domain"], r["site_class"]): (r["risk_class"], r["leisure"], r["is_work"]) for r in M.with_classes(events, rules, F.col("domain"), F.col("site_class")).collect()}
    plain = {(r["domain"], r["label"]): (r["risk_class"], r["leisure"], r["is_work"]) for r in C.classify_domains(events).collect()}
    for (domain, label), x in got.items():
        if domain and "big.example" not in domain and "needle" not in domain:
            assert x == plain[domain.lower(), label or ""], (domain, label)
    assert got["site7.big.example", None] == (None, "new", True) and got["no.site7.big.example", None] == (None, "new", True)
    assert got["site8.big.example", None] == ("netdisk", None, False) and got["k-needle13-k.org", None][0] == "recruitment" and got["", None] == (None, None, False)


def greedy(rows):
    kept, seen = [], {}
    windows = {}
    for who, at, key in rows:
        windows.setdefault((who, at), set()).add(key)
    for who, at in sorted(windows, key=lambda x: (x[0] or "", x[1])):
        mine = windows[who, at]
        if not mine & seen.setdefault(who, set()):
            seen[who] |= mine
            kept.append((who, at))
    return sorted(kept, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_by_components(spark, seed):
    rnd = random.Random(seed)
    at = lambda k: dt.datetime(2026, 7, 1) + dt.timedelta(hours=k)
    rows = [(rnd.choice(["p1", "p2"]), at(rnd.randrange(120)), f"k{rnd.randrange(60)}") for _ in range(200)]
    rows += [("chain", at(k), f"c{k + d}") for k in range(70) for d in (0, 1)] + [("solo", at(1), "k"), ("solo", at(2), "m")]
    keys = spark.createDataFrame(rows, "employee_id string, window_start timestamp_ntz, trigger_key string")
    assert sorted(map(tuple, W.suppress_repeats(keys).collect()), key=str) == greedy(rows)
    groups = W.key_components(keys).filter("employee_id = 'chain'").select("group").distinct().collect()
    assert [r[0] for r in groups] == [at(0)]
