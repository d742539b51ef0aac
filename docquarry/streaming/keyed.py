"""Keyed state on streams: the last good record of each key, and the exploration state machine one action at a time.

Both run in event time and append mode: the first is a session window, the second a ``transformWithState`` processor. That needs the RocksDB
state store, which ``drain_appends`` sets for the query it runs; a query goes on from its checkpoint folder.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docquarry.operators.controller import ACTIVE, INACTIVE, OPENED, PRUNED

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_good(records: DataFrame, key: str, line: str, good: Any, at: str, late: str = "1 hour", quiet_ms: int = 0) -> DataFrame:
    """``records`` (a stream) compacted as ``operators.results.compact`` does it: good ones only, of a key the last, with ``first_line``.

    Micro-batches may hold the lines in any order; rows later than ``late`` behind the newest may go. Records of a key belong together
    while no two neighbours are ``late`` and ``quiet_ms`` apart: a session window, so what comes after such a pause starts anew, whatever
    micro-batches the records came in. Its row leaves once the watermark has passed the newest record by that pause, and the state goes with it.
    """
    kept = records.where(good & F.col(key).isNotNull() & F.col(line).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    session = F.session_window(F.col(at), f"{late} {max(quiet_ms, 1)} milliseconds")
    last = kept.groupBy(key, session).agg(F.max_by(F.struct(*kept.columns), line).alias("last"), F.min(line).cast("long").alias("first_line"))
    return last.select("last.*", "first_line")


def _millis(ts: Any) -> int:
    return int(ts.timestamp() * 1000)


#: What an action makes of its target.
_BECOMES = {"activate": ACTIVE, "open": OPENED, "prune": PRUNED}


def taken(states: list[str], node: int, action: str, allowed: bool) -> bool:
    """Whether the page (node 0) or element takes the action; what it changes is written into ``states``. See ``controller.replay``."""
    page_lives, element = states[0] != PRUNED, node > 0
    if action == "activate":
        ok = allowed and (page_lives or not element)
    elif action == "open":
        ok = element and page_lives and states[node] == ACTIVE
    else:
        ok = states[node] != PRUNED
    if ok:
        states[node] = _BECOMES[action]
        if action == "activate" and states[0] == INACTIVE:
            states[0] = ACTIVE
    return ok


class PageMachine(StatefulProcessor):
    """The states of the pages of a bucket; actions wait until the watermark says that none before them is missing.

    A call to the state store costs more than an action's work. So the actions that came together are one value, a bucket has one timer,
    and a page's state is read and written once for all actions that have become ready.
    """

    def __init__(self, by: list[T.StructField], n_nodes: int):
        self.by, self.n_nodes = by, n_nodes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        state = T.StructType([T.StructField("states", T.ArrayType(T.StringType())), T.StructField("n_actions", T.IntegerType()), T.StructField("n_refused", T.IntegerType())])
        self.pages = handle.getMapState("pages", T.StructType(self.by), state)
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("actions", T.BinaryType())]))

    def _wake(self, at: int) -> None:
        """The bucket's timer goes off at ``at``, or earlier if it was to."""
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = [(_millis(r[1 + len(self.by)]), *r[1:]) for r in rows]
        self.waiting.appendValue((pickle.dumps(came),))
        self._wake(min(r[0] for r in came))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        ready_to, n_by = timerValues.getCurrentWatermarkInMs(), len(self.by)
        held = [r for (actions,) in self.waiting.get() for r in pickle.loads(actions)]
        rest, ready = [r for r in held if r[0] > ready_to], {}
        for r in held:
            if r[0] <= ready_to:
                ready.setdefault(r[1 : 1 + n_by], []).append(r[1 + n_by :])
        if rest:
            self.waiting.put([(pickle.dumps(rest),)])
            self.handle.registerTimer(min(r[0] for r in rest))
        else:
            self.waiting.clear()
        shape = Row(*[f.name for f in self.by], "states", "n_actions", "n_refused")
        for page, actions in ready.items():
            states, n, refused = self.pages.getValue(page) or ([INACTIVE] * self.n_nodes, 0, 0)
            states = list(states)
            for *_, node, action, allowed in sorted(actions):
                n += 1
                if action in _BECOMES and not taken(states, node, action, allowed):
                    refused += 1
            self.pages.updateValue(page, (states, n, refused))
            yield shape(*page, states, n, refused)

    def close(self) -> None:
        pass


def state_machine(actions: DataFrame, by: list[str], order: list[str], n_nodes: int, late: str = "1 hour", buckets: int = 512) -> DataFrame:
    """``(*by, states, n_actions, n_refused)`` each time the watermark passes actions of a page: the row of most actions is the last.

    ``actions`` (a stream) is as for ``controller.replay``; ``order`` starts with the event time. Rows may come out of order by up to ``late``.
    Each is applied once, to the stored state: a trace of any length needs one page's state and the actions that wait.

    Pages are dealt by a hash into ``buckets``, which a checkpoint holds on to. A task holds the waiting actions of one bucket at a time.
    """
    timed = actions.withColumn(order[0], F.col(order[0]).cast("timestamp")).withWatermark(order[0], late)
    kinds = [actions.schema[c] for c in by]
    out = T.StructType([*kinds, T.StructField("states", T.ArrayType(T.StringType())), T.StructField("n_actions", T.IntegerType()), T.StructField("n_refused", T.IntegerType())])
    dealt = timed.select(F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("bucket"), *by, *order, "node", "action", "allowed")
    return dealt.groupBy("bucket").transformWithState(PageMachine(kinds, n_nodes), out, "Append", "EventTime")


def drain_appends(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there now, from the checkpoint at ``path`` on; all rows it has given so far."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
