"""The engine over streams: access logs, sweeps, change events, learning in order.

Aggregations carry watermarks, so that their state is bounded; ordered learning keeps one small state per
conversation. Checkpoints of queries go where the caller says, on a folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memengine.config import DEFAULT, STATUSES, Config
from memengine.functions import ner, text
from memengine.functions.checkpoint import cut
from memengine.operators import learning, lifecycle

EVENTS = ["MEMORY_ADDED", "MEMORY_UPDATED", "MEMORY_DELETED", "MEMORY_FADED", "STATS_CHANGED", "CONTRADICTION_DETECTED", "MEMORY_SUPERSEDED"]


def changes(before: DataFrame, after: DataFrame, now_ms: int, verbose: bool = False) -> DataFrame:
    """(event_type, memory_id, ts, payload): what happened between two snapshots of the memory table."""
    b = before.select(F.col("id").alias("bid"), F.col("status").alias("bs"), F.col("updated_at").alias("bu"), F.lit(True).alias("b"))
    a = after.select("id", "status", "updated_at", "content", F.array_join("types", ", ").alias("kinds"), F.lit(True).alias("a"))
    j = b.join(a, F.col("bid") == F.col("id"), "full_outer")
    kind = (
        F.when(F.col("b").isNull(), "MEMORY_ADDED")
        .when(F.col("a").isNull(), "MEMORY_DELETED")
        .when((F.col("bs") != "faded") & (F.col("status") == "faded"), "MEMORY_FADED")
        .when((F.col("bs") != "superseded") & (F.col("status") == "superseded"), "MEMORY_SUPERSEDED")
        .when((F.col("bs") != F.col("status")) | (F.col("bu") != F.col("updated_at")), "MEMORY_UPDATED")
    )
    told = F.to_json(F.struct("content", "kinds", "status")) if verbose else F.lit(None).cast("string")
    return j.select(kind.alias("event_type"), F.coalesce("id", "bid").alias("memory_id"), F.lit(now_ms).alias("ts"), told.alias("payload")).filter("event_type is not null")


def all_changes(before: DataFrame, after: DataFrame, contradictions: DataFrame, now_ms: int, verbose: bool = False) -> DataFrame:
    """changes, with an event for each contradiction, and one of the counts by status if anything changed."""
    used = ["id", "status", "updated_at", "content", "types"]
    after = cut(after.select(*(c if verbose or c not in used[3:] else F.lit(None).cast(after.schema[c].dataType).alias(c) for c in used)))  # read three times
    told = cut(changes(before, after, now_ms, verbose))
    found = contradictions.select(
        F.lit("CONTRADICTION_DETECTED").alias("event_type"), F.col("new_id").alias("memory_id"), F.lit(now_ms).alias("ts"), F.to_json(F.struct("id", "similarity", "resolution")).alias("payload")
    )
    counts = after.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    stats = counts.join(told.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_semi").select(
        F.lit("STATS_CHANGED").alias("event_type"), F.lit(None).cast("string").alias("memory_id"), F.lit(now_ms).alias("ts"), F.to_json(F.struct("*")).alias("payload")
    )
    return told.unionByName(found).unionByName(stats)


def bridge(events: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], path: str):
    """Hand each micro-batch of events on to the sink of its type; a sink that fails does not stop others."""

    def out(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch.filter(F.col("event_type") == name))
                except Exception as e:  # a handler's error stays its own
                    print(f"event sink {name}: {e}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(out).option("checkpointLocation", path)


def debounced(accesses: DataFrame, cfg: Config = DEFAULT, late: str = "1 minute") -> DataFrame:
    """Stream (id, ts) to one row for each memory and debounce window."""
    w = F.window("ts", f"{cfg.debounce_ms} milliseconds")
    return accesses.withWatermark("ts", late).groupBy("id", w).agg(F.count(F.lit(1)).alias("n")).select("id", F.unix_millis("window.start").alias("window_ms"), "n")


def sessions(accesses: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stream (user_id, ts) to sessions with their length."""
    s = F.session_window("ts", gap)
    return accesses.withWatermark("ts", late).groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def periodic_sweep(clock: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame], None], path: str, every: str = "1 hour", cfg: Config = DEFAULT):
    """A sweep for each tick of a stream (timestamp); the next starts when the last has been stored."""

    def tick(batch: DataFrame, _: int) -> None:
        row = batch.agg(F.max(F.unix_millis("timestamp")).alias("now")).first()
        if row["now"] is not None:
            store(lifecycle.sweep(load(), int(row["now"]), cfg))

    return clock.writeStream.foreachBatch(tick).trigger(processingTime=every).option("checkpointLocation", path)


LEARNED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("predicate", T.StringType()), T.StructField("object", T.StringType()),
        T.StructField("action", T.StringType()), T.StructField("content", T.StringType()),
    ]
)
STATE = T.StructType([T.StructField("seen", T.StringType())])


def learn_stream(turns: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """Stream (conv_id, turn, role, text) to decisions, in order within each conversation.

    State of a conversation: the object last learned for each predicate, and its linker's tables. All turns of a
    trigger are ordered before they are folded.
    """
    import json

    buckets = [(name, __import__("re").compile(p)) for name, p in text.BUCKETS]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"known": {}, "linker": {}}
        known: dict[str, str] = saved["known"]
        linker = learning.Linker()
        vars(linker).update(saved["linker"])
        rows = []
        parts = [pdf[pdf["role"] == "user"] for pdf in batches]
        if parts:  # a trigger's turns of a conversation may come in several Arrow batches
            for turn, said in pd.concat(parts).sort_values("turn", kind="stable")[["turn", "text"]].itertuples(index=False):
                a = ner.analyze_text(said, now_ms)
                kinds = a["types"]
                threshold = min([cfg.type_threshold.get(k, cfg.threshold) for k in kinds], default=cfg.threshold)
                if cfg.w_novelty + cfg.w_specificity * a["specificity"] < threshold or not a["entities"]:
                    continue
                from memengine.config import PREDICATE

                predicate = PREDICATE[kinds[0]] if kinds else "prefers"
                what = "+".join(sorted(linker.link(key[0], e["kind"], e["value"])[0] for e in a["entities"]))
                bucket = next((name for name, p in buckets if p.search((said or "").lower())), "unspecified")
                if known.get(predicate) == what:
                    action = "IGNORE"
                elif predicate not in known:
                    action = "ADD"
                else:
                    action = "SUPERSEDE" if bucket in ("transition", "past") else "UPDATE"
                known[predicate] = what
                rows.append((int(key[0]), int(turn), predicate, what, action, said))
        state.update((json.dumps({"known": known, "linker": vars(linker)}),))
        yield pd.DataFrame(rows, columns=[f.name for f in LEARNED])

    return turns.groupBy("conv_id").applyInPandasWithState(step, LEARNED, STATE, "append", GroupStateTimeout.NoTimeout)
