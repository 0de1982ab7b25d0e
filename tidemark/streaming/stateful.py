"""Rolling forms of the operators: the batch folds with their state kept by Structured Streaming.

A fold's state is small (an open segment, a few centroids), so it is kept as
one binary value for each title. Within a micro-batch a title's rows are taken
in media order; a fold that closes on silence is ended by ``flush`` when the
title has been idle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Fold

C = F.col


def stream_fold(stream: DataFrame, by: str, order: list[str], fold: Callable[[], Fold], schema: str, idle_ms: int | None = None) -> DataFrame:
    """The rows of ordered_fold, as the stream brings them. schema starts with the key column. With ``idle_ms`` a title that gets nothing for so long is flushed."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: Fold = pickle.loads(state.get[0]) if state.exists else fold()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, *x) for x in now.flush()], columns=names)
            return
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [(*key, *x) for row in rows.itertuples(index=False) for x in now.push(row)]
        state.update((pickle.dumps(now),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy(by).applyInPandasWithState(step, schema, "state binary", "append", timeout)


def dedupe_ids(stream: DataFrame, at: str = "at", late: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark: a replay adds nothing."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])


def source_status(stream: DataFrame, at: str = "at", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each source and title in tumbling windows, given out when the watermark has passed them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), "title_id", "source").agg(F.count("*").alias("event_count"), F.max("start_ms").alias("last_event_at"))


def sessions(stream: DataFrame, at: str = "at", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity of each title in sessions parted by a pause."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), "title_id").agg(F.count("*").alias("events"))


class RangeSet:
    """Disjoint ranges in order; those that touch are one. Sets merge in any order and as often as one likes."""

    def __init__(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        none = np.zeros(0, np.int64)
        self.starts, self.ends = none if starts is None else starts, none if ends is None else ends

    def add(self, starts: np.ndarray, ends: np.ndarray) -> None:
        s, e = np.concatenate([self.starts, starts]), np.concatenate([self.ends, np.maximum(starts, ends)])
        order = np.argsort(s, kind="stable")
        s, reach = s[order], np.maximum.accumulate(e[order])
        new = np.append(True, s[1:] > reach[:-1]) if len(s) else np.zeros(0, bool)
        self.starts, self.ends = s[new], reach[np.append(new[1:], True)] if len(s) else s

    def covered(self) -> int:
        return int((self.ends - self.starts).sum())


_STATUS = "title_id long, chunk long, events long, covered_ms long, first_ms long, last_ms long, end_ms long"


def live_status(stream: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """Per title and chunk of media time: what ``status`` needs, each time a batch brings something (update mode).

    The state of a key is the set of disjoint ranges covered in its chunk, four numbers besides. A range over several chunks is cut
    at their borders and counted once, in its first; a null end is a point; rows without a start count as events of chunk null,
    and of these the end tells how far the title goes. Rows may come late or in any order: sets merge, nothing is dropped.
    """
    end = F.greatest("start_ms", F.coalesce("end_ms", "start_ms"))
    own = F.floor(C("start_ms") / chunk_ms)
    rows = stream.select("title_id", C("start_ms").cast("long").alias("start_ms"), F.coalesce("end_ms", "start_ms").cast("long").alias("end_ms"), end.alias("_end"), own.alias("_own"))
    rows = rows.withColumn("chunk", F.explode_outer(F.when(own.isNotNull(), F.sequence(own, F.floor(C("_end") / chunk_ms)))))
    low, high = F.greatest("start_ms", C("chunk") * chunk_ms), F.least("_end", (C("chunk") + 1) * chunk_ms)
    rows = rows.select("title_id", "chunk", low.alias("low"), high.alias("high"), F.coalesce(C("chunk") == C("_own"), F.lit(True)).alias("own"), "start_ms", "end_ms")
    least = lambda *x: min((int(v) for v in x if not pd.isna(v)), default=None)
    most = lambda *x: max((int(v) for v in x if not pd.isna(v)), default=None)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, events, first, last, end = pickle.loads(state.get[0]) if state.exists else (None, None, 0, None, None, None)
        held = RangeSet(starts, ends)
        for b in batches:
            known = b[b["low"].notna()]
            held.add(known["low"].to_numpy("int64"), known["high"].to_numpy("int64"))
            mine = b[b["own"]]
            events += len(mine)
            first, last, end = least(first, mine["start_ms"].min()), most(last, mine["start_ms"].max()), most(end, mine["end_ms"].max())
        state.update((pickle.dumps((held.starts, held.ends, events, first, last, end)),))
        yield pd.DataFrame({n: pd.array([v], "Int64") for n, v in zip([x.split(" ")[0] for x in _STATUS.split(", ")], (*key, events, held.covered(), first, last, end))})

    return rows.groupBy("title_id", "chunk").applyInPandasWithState(step, _STATUS, "state binary", "update", GroupStateTimeout.NoTimeout)


def status_log(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for live_status: path/batch=N has the keys that batch N changed, and no others."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_status(log: DataFrame) -> DataFrame:
    """title_id, events, ratio, per_minute as of the last batch in the log: each key's latest row, summed over the title's chunks."""
    values = [x.split(" ")[0] for x in _STATUS.split(", ")][2:]
    now = log.groupBy("title_id", "chunk").agg(F.max_by(F.struct(*values), "batch").alias("x")).select("title_id", "x.*")
    t = now.groupBy("title_id").agg(F.sum("events").alias("events"), F.sum("covered_ms").alias("covered"), F.max("end_ms").alias("end"), ((F.max("last_ms") - F.min("first_ms")) / 60_000).alias("minutes"))
    ratio = F.when(C("end") > 0, F.least(F.lit(1.0), C("covered") / C("end")))
    return t.select("title_id", "events", ratio.alias("ratio"), F.when(C("minutes") > 0, C("events") / C("minutes")).alias("per_minute"))


def _there(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def rolling_scenes(path: str, build: Callable[[DataFrame], DataFrame], behind_ms: int = 8000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: after batch N, path/scenes/batch=N has the scenes of every title with their status.

    Finalized scenes are carried over as they are; the others are built anew from the evidence behind them. That evidence is kept
    under path/open, so a batch reads what is open and not the whole past, which stays under path/evidence. Rows that end within a
    title's finalized prefix came too late: they are left out and counted in path/late; one that reaches beyond it counts from its end on. A seek back (source playback, kind seek,
    to_ms) opens finalized scenes that end at or after its target again, from the whole past. A batch that is run again writes the
    same; numbers may be skipped.
    """
    from ..plans.build import finalize

    def last_before(batch: DataFrame, table: str, number: int) -> str | None:
        if not _there(batch, f"{path}/{table}"):
            return None
        found = batch.sparkSession.read.parquet(f"{path}/{table}").where(C("batch") < number).agg(F.max("batch")).first()[0]
        return None if found is None else f"{path}/{table}/batch={found}"

    # of a row with an end at the prefix nothing is left
    beyond = (C("start_ms") >= C("until")) | (F.coalesce("end_ms", "start_ms") > C("until"))

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write = lambda df, table: df.write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")
        before = last_before(batch, "scenes", number)
        final, reopened = spark.read.parquet(before).where("status = 'finalized'") if before else None, False
        if final is not None:
            back = batch.where("source = 'playback' and kind = 'seek'").groupBy("title_id").agg(F.min("to_ms").alias("to_ms"))
            reopened = not back.isEmpty()
            final = final.join(back.hint("merge"), "title_id", "left").where("to_ms is null or end_ms < to_ms").drop("to_ms")
            until = final.groupBy("title_id").agg(F.max("end_ms").alias("until"))
            known = batch.join(until.hint("merge"), "title_id", "left")
            late = C("until").isNotNull() & ~beyond
            write(known.where(late).groupBy("title_id").agg(F.count("*").alias("late_events")), "late")
            batch = known.where(~late).drop("until")
        write(batch, "evidence")
        fresh = spark.read.parquet(f"{path}/evidence/batch={number}")
        held_before = None if reopened else last_before(batch, "open", number)
        held = spark.read.parquet(held_before).unionByName(fresh) if held_before else spark.read.parquet(f"{path}/evidence").where(C("batch") <= number).drop("batch")
        heads = fresh.groupBy("title_id").agg(F.max(F.coalesce("end_ms", "start_ms")).alias("now_ms"))
        heads_before = last_before(batch, "playhead", number)
        if heads_before:
            heads = heads.unionByName(spark.read.parquet(heads_before)).groupBy("title_id").agg(F.max("now_ms").alias("now_ms"))
        write(heads, "playhead")
        if final is not None:
            held = held.join(until.hint("merge"), "title_id", "left").where(C("until").isNull() | beyond)
            held = held.withColumn("start_ms", F.greatest("start_ms", "until")).drop("until")
        write(held, "open")
        scenes = finalize(build(spark.read.parquet(f"{path}/open/batch={number}")), spark.read.parquet(f"{path}/playhead/batch={number}"), behind_ms)
        write(scenes if final is None else scenes.unionByName(final), "scenes")

    return run


def emit_once(silences: DataFrame, seen: DataFrame) -> DataFrame:
    """Silences that start after the last one given out of their title (seen: title_id, last_ms)."""
    return silences.join(seen, "title_id", "left").where(C("last_ms").isNull() | (C("start_ms") > C("last_ms"))).drop("last_ms")
