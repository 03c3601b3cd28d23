"""Keyed state in event time: identity, alerts, feed silence.

Each processor keeps what has arrived until the watermark has passed it and then works in order of event time, so results
do not depend on how rows are cut into micro-batches or in which order they come (within the watermark's delay; later rows
go to the side table of `start_split`).  Processors are made inside functions: such classes travel by value, so an
executor needs no copy of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions.base import micros
from ..functions.parsing import clean_account
from ..schema import Rules

# ------------------------------------------------------------------ identity


def account_processor():
    """Stamps each row with the latest account of its key up to and including it."""
    from pyspark.sql.streaming import StatefulProcessor

    class Accounts(StatefulProcessor):
        def init(self, handle):
            self._handle = handle
            # One state row for each batch of rows: times and ids packed, hints with their places.
            self._waiting = handle.getListState("waiting", "at binary, id binary, place binary, hints array<string>")
            self._known = handle.getValueState("known", "account string")

        def wait(self, at, ids, place, hints):
            """Keep rows; `place` are the rows that have a hint."""
            self._waiting.appendValue((at.tobytes(), ids.tobytes(), place.tobytes(), hints))
            self._handle.registerTimer(int(at.min()) // 1000 + 1)

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            parts = []
            for pdf in rows:
                if len(pdf):
                    place = [k for k, h in enumerate(pdf["hint"]) if isinstance(h, str) and h]
                    parts.append((pdf["at"].to_numpy("int64"), pdf["id"].to_numpy("int64"), np.array(place, "int64"), list(pdf["hint"].iloc[place])))
            if parts:
                self.wait(*joined(parts))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import numpy as np
            import pandas as pd
            limit = timerValues.getCurrentWatermarkInMs() * 1000
            parts = [(*(np.frombuffer(bytes(r[k]), "int64") for k in range(3)), list(r[3])) for r in self._waiting.get()]
            if not parts:
                return
            at, ids, place, hints = joined(parts)
            hinted = np.full(len(at), -1)
            hinted[place] = np.arange(len(place))
            order = np.lexsort((ids, at))
            order = order[at[order] < limit]
            if not len(order):
                return
            late = np.flatnonzero(at >= limit)
            self._waiting.clear()
            if len(late):
                own = hinted[late]
                self.wait(at[late], ids[late], np.flatnonzero(own >= 0), [hints[k] for k in own[own >= 0]])
            # Place 0 is what is known from before; a row takes the last hint up to it.
            accounts = np.array([self._known.get()[0] if self._known.exists() else None, *hints], dtype=object)
            ready = hinted[order] + 1
            last = np.maximum.accumulate(np.where(ready > 0, np.arange(len(ready)), -1))
            found = accounts[np.where(last >= 0, ready[last], 0)]
            if found[-1] is not None:
                self._known.update((found[-1],))
            yield pd.DataFrame({"id": ids[order], "at": at[order], "key": key[0], "account": pd.Series(found, dtype=object)})

        def close(self):
            pass

    def joined(parts):
        """(at, ids, place, hints) of several such parts."""
        import numpy as np
        at, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        starts = np.cumsum([0, *[len(p[0]) for p in parts]])
        return at, ids, np.concatenate([p[2] + s for p, s in zip(parts, starts)]), [h for p in parts for h in p[3]]

    return Accounts()


def stream_asof(rows: DataFrame, key: str, hint: str, late: str = "1 hour") -> DataFrame:
    """(id, at, key, account): the latest non-empty `hint` of the same `key` up to each row.

    `rows` has event_id, a zoned occurred_at, `key` and `hint`.  A row is emitted when the watermark passes it.
    """
    keyed = (rows.withWatermark("occurred_at", late)
             .select(F.col("event_id").alias("id"), "occurred_at", F.unix_micros("occurred_at").alias("at"), F.col(key).alias("key"), F.col(hint).alias("hint")))
    return keyed.groupBy("key").transformWithStateInPandas(account_processor(), "id bigint, at bigint, key string, account string", "append", "EventTime")


def stream_mapped(rows: DataFrame, key: str, hint: str, late: str = "1 hour") -> DataFrame:
    """`stream_asof` for rows some of which lack the key: those know no hint but their own, at once and without state."""
    alone = rows.filter(F.col(key).isNull()).select(
        F.col("event_id").alias("id"), F.unix_micros("occurred_at").alias("at"), F.lit(None).cast("string").alias("key"), F.nullif(F.col(hint), F.lit("")).alias("account"))
    return stream_asof(rows.filter(F.col(key).isNotNull()), key, hint, late).unionByName(alone)


def hinted(rows: DataFrame, suffixes=("corp", "example", "local")) -> DataFrame:
    """Account of the path as `hint`, and the two keys (null: none) under which later rows find it."""
    key = lambda c: F.nullif(F.col(c), F.lit(""))
    return (rows.withColumn("hint", F.nullif(clean_account("account_hint", suffixes), F.lit("")))
            .withColumn("agent_key", key("agent_id")).withColumn("user_key", key("user_no")))


def resolved(rows: DataFrame, by_agent: DataFrame, by_user: DataFrame) -> DataFrame:
    """`employee_id` of `hinted` rows: path account, account of the machine, of the user id, or a placeholder."""
    agent, user = (d.select(F.col("id").alias("event_id"), F.col("account").alias(n)) for d, n in ((by_agent, "_a"), (by_user, "_u")))
    number = F.coalesce(F.nullif(F.col("agent_id"), F.lit("")), F.nullif(F.col("user_no"), F.lit("")))
    return (rows.join(agent, "event_id").join(user, "event_id")
            .withColumn("employee_id", F.coalesce("hint", "_a", "_u", F.concat(F.lit("AGENT:"), number)))
            .drop("_a", "_u", "hint", "agent_key", "user_key"))


# ------------------------------------------------------------------ alerts

ALERT_CHANGE = ("dedup_key string, change long, employee_id string, scenario string, risk_score int, verdict_id string, summary string, status string, "
                "window_us bigint, created_us bigint, changed_us bigint")
CHANGES = "kind string, at bigint, id string, score int, text string, start bigint, expires bigint"


def alert_processor(stale_us: int, low: int = 50, high: int = 65):
    """State machine of one alert key (person and intent); every change is emitted with a rising number.

    Verdicts, feedback and exemptions carry their own times.  What is shown follows the newest verdict by (window start,
    id); the status follows the newest of verdict and feedback; so the end state does not depend on the order of arrival.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Alerts(StatefulProcessor):
        def init(self, handle):
            self._handle = handle
            self._waiting = handle.getListState("waiting", CHANGES_DDL)
            # Alert and exemptions are one state row: most of a key's time goes into calls to the state.
            self._kept = handle.getValueState("kept", "score int, id string, text string, start bigint, status string, since bigint, created bigint, changed bigint, change bigint, "
                                                      "exempt_at array<bigint>, exempt_until array<bigint>")
            self._timer = handle.getValueState("timer", "at bigint")

        def wake(self, us):
            """A key has one timer, the earliest it needs."""
            at, old = us // 1000 + 1, self._timer.get()
            if old is not None and old[0] <= at:
                return
            if old is not None:
                self._handle.deleteTimer(old[0])
            self._handle.registerTimer(at)
            self._timer.update((at,))

        def handleInputRows(self, key, rows, timerValues):
            new = [(r["kind"], r["at"], r["id"], r["score"], r["text"], r["start"], r["expires"]) for r in rows]
            if new:
                self._waiting.appendList(new)
                self.wake(min(n[1] for n in new))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            from pyspark.sql import Row
            limit = timerValues.getCurrentWatermarkInMs() * 1000
            self._timer.clear()
            waiting = [tuple(r) for r in self._waiting.get()]
            rank = {"exempt": 0, "verdict": 1, "feedback": 2}
            ready = sorted((r for r in waiting if r[1] < limit), key=lambda r: (r[1], rank[r[0]], r[5], r[2] or ""))
            rest = [r for r in waiting if r[1] >= limit]
            kept = self._kept.get()
            alert = tuple(kept[:9]) if kept is not None and kept[8] is not None else None
            exempt = list(zip(kept[9], kept[10])) if kept is not None else []
            out, wakes = [], [r[1] for r in rest]

            def closed(now):
                """The alert after the rule that closes deviations: low scores at once, middle ones when stale."""
                score, id_, text, start, status, since, created, _, change = alert
                if key[0].endswith("|baseline_deviation") and status == "NEW" and (score < low or (score <= high and created + stale_us < now)):
                    return (score, id_, text, start, "CLOSED", max(since, created + stale_us if score >= low else since), created, now, change)
                return alert

            for kind, at, id_, score, text, start, expires in ready:
                if alert is not None:
                    alert = closed(at)
                if kind == "exempt":
                    exempt = [e for e in exempt if e[1] < 0 or e[1] > at] + [(at, expires)]
                    continue
                if kind == "verdict":
                    if any(e[0] <= at and (e[1] < 0 or e[1] > at) for e in exempt):
                        continue
                    if alert is None:
                        alert = (score, id_, text, start, "NEW", at, at, at, 0)
                    else:
                        newest = (start, id_) > (alert[3], alert[1])
                        shown = (score, id_, text, start) if newest else alert[:4]
                        alert = (*shown, "NEW", at, alert[6], at, alert[8])
                elif alert is not None:
                    alert = (*alert[:4], id_, at, alert[6], at, alert[8])
                else:
                    continue
                alert = closed(at)
                alert = (*alert[:8], alert[8] + 1)
                out.append(alert)
            if alert is not None:
                done = closed(limit)
                if done[4] != alert[4]:
                    alert = (*done[:8], alert[8] + 1)
                    out.append(alert)
                due = alert[6] + stale_us
                if alert[4] == "NEW" and key[0].endswith("|baseline_deviation") and low <= alert[0] <= high and due >= limit:
                    wakes.append(due)
            if alert is not None or exempt:
                self._kept.update((*(alert or [None] * 9), [e[0] for e in exempt], [e[1] for e in exempt]))
            elif kept is not None:
                self._kept.clear()
            if rest:
                self._waiting.put(rest)
            elif waiting:
                self._waiting.clear()
            if wakes:
                self.wake(min(wakes))
            person, _, scenario = key[0].rpartition("|")
            for score, id_, text, start, status, _, created, changed, change in out:
                yield Row(dedup_key=key[0], change=change, employee_id=person, scenario=scenario, risk_score=score, verdict_id=id_, summary=text, status=status,
                          window_us=start, created_us=created, changed_us=changed)

        def close(self):
            pass

    CHANGES_DDL = "kind string, at bigint, id string, score int, text string, start bigint, expires bigint"
    return Alerts()


def verdict_changes(verdicts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Verdicts from the alert score on as changes; a verdict happens when its window ends."""
    null = F.lit(-1).cast("long")
    return verdicts.filter(F.col("risk_score") >= rules.alert_score).select(
        F.concat_ws("|", "employee_id", "intent").alias("dedup_key"), F.col("window_end").cast("timestamp").alias("occurred_at"), F.lit("verdict").alias("kind"),
        micros("window_end").alias("at"), F.col("verdict_id").alias("id"), F.col("risk_score").cast("int").alias("score"), F.col("explanation").alias("text"),
        micros("window_start").alias("start"), null.alias("expires"))


def feedback_changes(feedback: DataFrame) -> DataFrame:
    """(dedup_key, label, created_at) with label TP or FP as changes of status."""
    null = F.lit(-1).cast("long")
    return feedback.filter(F.col("label").isin("TP", "FP")).select(
        "dedup_key", F.col("created_at").cast("timestamp").alias("occurred_at"), F.lit("feedback").alias("kind"), micros("created_at").alias("at"),
        F.when(F.col("label") == "TP", "CONFIRMED").otherwise("FP").alias("id"), F.lit(0).alias("score"), F.lit(None).cast("string").alias("text"), null.alias("start"), null.alias("expires"))


def exemption_changes(exemptions: DataFrame) -> DataFrame:
    """(employee_id, signal_type, valid_from, expires_at) as changes; no expiry is -1."""
    null = F.lit(-1).cast("long")
    return exemptions.select(
        F.concat_ws("|", "employee_id", "signal_type").alias("dedup_key"), F.col("valid_from").cast("timestamp").alias("occurred_at"), F.lit("exempt").alias("kind"),
        micros("valid_from").alias("at"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("score"), F.lit(None).cast("string").alias("text"), null.alias("start"),
        F.coalesce(micros("expires_at"), null).alias("expires"))


def stream_alerts(changes: DataFrame, stale_days: int = 3, late: str = "1 hour") -> DataFrame:
    """Versions of alerts as changes reach them."""
    rows = changes.withWatermark("occurred_at", late)
    return rows.groupBy("dedup_key").transformWithState(alert_processor(stale_days * 86_400_000_000), ALERT_CHANGE, "append", "EventTime")


def alert_snapshot(changes: DataFrame) -> DataFrame:
    """Latest version of each alert."""
    from ..functions.base import from_micros
    last = changes.groupBy("dedup_key").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "dedup_key"]), "change").alias("a"))
    return last.select("dedup_key", "a.employee_id", "a.scenario", E.severity("a.risk_score").alias("severity"), "a.risk_score", "a.verdict_id", "a.summary", "a.status",
                       from_micros("a.window_us").alias("window_start"), from_micros("a.created_us").alias("created_at"))


# ------------------------------------------------------------------ feed silence

def silence_processor(limit_us: int, from_hour: int, until_hour: int):
    """Alarms of one feed: silent for longer than the limit in duty hours, once a day."""
    from pyspark.sql.streaming import StatefulProcessor
    hour, day = 3_600_000_000, 86_400_000_000

    class Silence(StatefulProcessor):
        def init(self, handle):
            self._handle = handle
            self._waiting = handle.getListState("waiting", "low bigint, high bigint")
            self._state = handle.getValueState("state", "last bigint, told bigint")

        def handleInputRows(self, key, rows, timerValues):
            earliest = None
            for pdf in rows:
                self._waiting.appendList([(int(a), int(b)) for a, b in zip(pdf["low"], pdf["high"])])
                low = int(pdf["low"].min())
                earliest = low if earliest is None else min(earliest, low)
            if earliest is not None:
                self._handle.registerTimer(earliest // 1000 + 1)
            return iter([])

        def alarms(self, last, told, until):
            """Times in (last + limit, until) at which the feed is reported."""
            found, d = [], (last + limit_us) // day
            while d * day < until:
                at = max(last + limit_us, d * day + from_hour * hour)
                if d > told and at < min(until, d * day + until_hour * hour):
                    found.append(at)
                    told = d
                d += 1
            return found, told

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd
            now = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = sorted(tuple(r) for r in self._waiting.get())
            last, told = self._state.get() if self._state.exists() else (None, -1)
            out, rest = [], []
            for low, high in waiting:
                if low >= now:
                    rest.append((low, high))
                    continue
                if last is not None and low > last:
                    found, told = self.alarms(last, told, low)
                    out += [(last, at) for at in found]
                seen = high if high < now else low
                last = seen if last is None else max(last, seen)
                if high >= now:
                    rest.append((high, high))
            if last is not None:
                found, told = self.alarms(last, told, now)
                out += [(last, at) for at in found]
                self._state.update((last, told))
                d = max((last + limit_us) // day, told + 1)  # the next day on which it may be reported
                ahead = max(last + limit_us, d * day + from_hour * hour)
                if ahead >= now:
                    self._handle.registerTimer(ahead // 1000 + 1)
            if rest:
                self._waiting.put(rest)
                self._handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
            else:
                self._waiting.clear()
            if out:
                yield pd.DataFrame({"feed": key[0], "last_us": [o[0] for o in out], "alarm_us": [o[1] for o in out]})

        def close(self):
            pass

    return Silence()


def stream_silence(messages: DataFrame, hours: int = 2, from_hour: int = 9, until_hour: int = 20, late: str = "10 minutes", slot_seconds: int = 600) -> DataFrame:
    """(feed, last_us, alarm_us) of `messages` (feed, received_at).

    There are few feeds, so each task first reduces its messages to first and last time per feed and slot; no gap inside a
    slot can be an alarm.
    """
    if slot_seconds > hours * 3600:
        raise ValueError("slots must be shorter than the limit")

    def reduced(batches):
        import pandas as pd
        for pdf in batches:
            if len(pdf):
                at = pdf["received_at"].astype("datetime64[us]").astype("int64")
                keys = pd.DataFrame({"feed": pdf["feed"], "slot": at // (slot_seconds * 1_000_000), "at": at})
                g = keys.groupby(["feed", "slot"])["at"].agg(["min", "max"]).reset_index()
                yield pd.DataFrame({"feed": g["feed"], "received_at": pd.to_datetime(g["max"], unit="us"), "low": g["min"], "high": g["max"]})

    rows = messages.select("feed", "received_at").mapInPandas(reduced, "feed string, received_at timestamp, low bigint, high bigint")
    return (rows.withWatermark("received_at", late).groupBy("feed")
            .transformWithStateInPandas(silence_processor(hours * 3_600_000_000, from_hour, until_hour), "feed string, last_us bigint, alarm_us bigint", "append", "EventTime"))
