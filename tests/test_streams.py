"""Streams against the batch forms of the same rules."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.bindings.folds import _SEG
from tidemark.operators import folds, sequences
from tidemark.operators.folds import ordered_fold
from tidemark.streaming.stateful import RangeSet, dedupe_ids, live_status, read_status, status_log, stream_fold

RANGES = st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(-2, 12)), max_size=8), max_size=5)


@settings(max_examples=200, deadline=None)
@given(RANGES)
def test_range_set(batches):
    held, cells, points = RangeSet(), set(), set()
    for b in batches:
        held.add(np.array([s for s, _ in b], np.int64), np.array([s + n for s, n in b], np.int64))
        cells |= {x for s, n in b for x in range(s, s + n)}
        points |= {s for s, _ in b} | {max(s, s + n) for s, n in b}
        assert held.covered() == len(cells)
        assert (held.starts[1:] > held.ends[:-1]).all() and (held.starts <= held.ends).all()
        assert all(any(s <= p <= e for s, e in zip(held.starts, held.ends)) for p in points)


def in_files(spark, path, df, parts):
    """The rows as a stream, one micro-batch for each part."""
    for rows in parts:
        spark.createDataFrame(rows, df).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df).option("maxFilesPerTrigger", 1).parquet(path)


def test_status_after_every_batch(spark, tmp_path):
    """Rows in any order, over borders of chunks, repeated, without ends or starts: each batch's log gives the status of all so far."""
    r = random.Random(3)
    schema = "title_id long, start_ms long, end_ms long, note string"
    at = lambda: r.choice([r.randrange(5000), r.randrange(5) * 1000])
    parts = [[(r.choice([1, 1, 2, None]), t, r.choice([t + r.randrange(2500), t, None, t - 5]), "x") for t in (at() for _ in range(40))] for _ in range(4)]
    parts[1] += [(1, None, 9000, "x"), (3, None, None, "x"), (4, 700, None, "x")] + parts[0][:5]
    stream = in_files(spark, str(tmp_path / "in"), schema, parts)
    log = str(tmp_path / "log")
    live_status(stream, 1000).writeStream.outputMode("update").foreachBatch(status_log(log)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    written = spark.read.parquet(log)
    order = [written.where(f"batch = {n}").count() for n in range(4)]
    assert all(order)
    # files are taken in the order of their times; after the last batch all are in
    show = lambda df: sorted(((x.title_id, x.events, x.ratio and round(x.ratio, 9), x.per_minute and round(x.per_minute, 9)) for x in df.select("title_id", "events", "ratio", "per_minute").collect()), key=repr)
    assert show(read_status(written)) == show(sequences.status(spark.createDataFrame(sum(parts, []), schema)))
    # a key stands once in a batch, and the same batch written again changes nothing
    keys = written.select("batch", "title_id", "chunk")
    assert keys.count() == keys.distinct().count()
    before, last = show(read_status(written)), written.where("batch = 3").drop("batch")
    status_log(log)(spark.createDataFrame(last.collect(), last.schema), 3)
    assert show(read_status(spark.read.parquet(log))) == before


def _frames(r, k, i):
    return (k, i, i * 20, r.choice([-60.0, -58.0, -30.0, -25.0]) if i // 25 % 2 else -60.0 + r.random(), r.random() / 2, r.random() / 4)


def _levels(r, k, i):
    return (k, i, i * 32, r.choice([-60.0, -55.0, -20.0]), r.choice([0.05, 0.1, 0.4]) if i < 50 else 0.05, 900.0 * r.random(), 5 * r.random(), 40.0)


def _moments(r, k, i):
    return (k, i, i * 300 + r.choice([0, 200]) + i // 15 * 800, r.random(), r.random(), r.choice([0.1, 0.1, 0.1, 0.7]))


def _caption(r, k, i):
    text = " ".join("one two three four five six seven eight".split()[: 1 + i % 6]) + ("" if i // 6 % 2 else " more")
    return (k, i, i * 900 + i // 12 * 6000, text, text, "fr" if i // 12 % 3 == 2 else "en")


def _voices(r, k, i):
    return (k, i, i * 1000, i * 1000 + 800, [r.choice([-1.0, 1.0]) + r.random() / 4 for _ in range(4)])


CASES = {
    "throttle": (lambda: folds.Throttle(2000), "seq long, at_ms long", "seq long, at_ms long", lambda r, k, i: (k, i, i * 700)),
    "speech": (folds.Speech, "start_ms long, end_ms long, mean_excess_db double, peak_db double", "seq long, at_ms long, db double, zcr double, flatness double", _frames),
    "onsets": (folds.Onsets, "at_ms long, kind string, prominence_db double, attack double, centroid double, flatness double", "seq long, at_ms long, level double, flatness double, centroid double, flux double, spectrum_sum double", _levels),
    "segments": (folds.Segments, _SEG.removeprefix("title_id long, "), "seq long, at_ms long, importance double, motion double, cut double", _moments),
    "captions": (folds.Captions, "text string, start_ms long, end_ms long, language string, progressive boolean", "seq long, at_ms long, text string, comparable string, language string", _caption),
    "speakers": (lambda: folds.Speakers(0.6, 0.9), "seq long, speaker string, distance double, turn_change boolean, confidence string", "seq long, start_ms long, end_ms long, feature array<double>", _voices),
}


@pytest.mark.parametrize("name", CASES)
def test_folds_as_streams(spark, tmp_path, name):
    """Over three batches a stream gives the batch's rows, but for what is open at its end."""
    fold, schema, columns, make = CASES[name]
    schema, columns = f"title_id long, {schema}", f"title_id long, {columns}"
    order = ["start_ms" if name == "speakers" else "at_ms", "seq"]
    r = random.Random(1)
    parts = [[make(r, k, i) for k in (1, 2) for i in range(n * 40, n * 40 + 40)] for n in range(3)]
    stream = in_files(spark, str(tmp_path / "in"), columns, parts)
    stream_fold(stream, "title_id", order, fold, schema).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    df = spark.createDataFrame(sum(parts, []), columns)
    batch = ordered_fold(df, ["title_id"], order, fold, schema).collect()
    still_open = []
    for k in (1, 2):
        one = fold()
        for row in df.where(f"title_id = {k}").orderBy(*order).collect():
            one.push(row)
        still_open += [(k, *x) for x in one.flush()]
    got = spark.table(name).collect()
    assert len(got) > 3 and sorted([*map(tuple, got), *still_open], key=repr) == sorted(map(tuple, batch), key=repr)


def test_replays_add_nothing(spark, tmp_path):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    rows = [(f"e{i}", t + datetime.timedelta(seconds=i)) for i in range(20)]
    stream = in_files(spark, str(tmp_path / "in"), "id string, at timestamp", [rows, rows[5:], rows])
    dedupe_ids(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(x.id for x in spark.table("once").collect()) == sorted(x for x, _ in rows)
