import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators.bitmap import Bitmap
from lectern.operators.snapshots import assign_ordinals, clean_hash, snapshot_changes


def test_bitmap_agrees_with_sets():
    rnd = np.random.default_rng(1)
    for n, m, top in ((0, 5, 10), (50, 60, 200_000), (9000, 70_000, 100_000), (70_000, 70_000, 70_000)):
        a, b = rnd.integers(0, top, n), rnd.integers(0, top, m)
        x, y = Bitmap.of(a), Bitmap.of(b)
        assert x.andnot(y).ordinals().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert x.and_(y).ordinals().tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert len(x) == len(set(a.tolist()))


def test_ordinals_persist_when_a_snapshot_is_added():
    before = assign_ordinals(np.array([1, 1, 2]), np.array([5, 3, 4]))
    after = assign_ordinals(np.array([1, 1, 2, 3]), np.array([5, 3, 4, 0]))
    assert before.tolist() == after[:3].tolist() == [1, 0, 2]


SCHEMA = "snap int, doc string, ordinal int, h string, at timestamp, change string"


def _changes(spark, rows, per_shard=200_000):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = snapshot_changes(df, "snap", ["doc", "ordinal"], clean_hash(F.col("h")), "at", per_shard)
    return sorted(map(tuple, out.collect()), key=str)


def _plain(rows):
    last = {}
    for s, d, o, h, at in rows:
        key, h = (s, d, o), None if h is None else h.strip().lower()
        rank = (at is not None, at or dt.datetime.min, h is not None, h or "")
        if key not in last or rank > last[key][0]:
            last[key] = (rank, h)
    nights, out = sorted({r[0] for r in rows}), []
    for a, b in zip(nights, nights[1:]):
        then = {k[1:]: v[1] for k, v in last.items() if k[0] == a}
        now = {k[1:]: v[1] for k, v in last.items() if k[0] == b}
        out += [(b, *k, "added") for k in now.keys() - then.keys()] + [(b, *k, "removed") for k in then.keys() - now.keys()]
        out += [(b, *k, "changed") for k in now.keys() & then.keys() if now[k] != then[k]]
    return sorted(out, key=str)


def test_changes_agree_with_a_plain_version(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2025, 1, 1)
    rows = [
        (rnd.randint(1, 4), rnd.choice(["a", "b", "hot", "hot", "hot", None]), rnd.choice([0, 1, 2, None]), rnd.choice(["x", " X", "y ", "z", None]), rnd.choice([None, t0, t0 + dt.timedelta(rnd.randint(0, 9))]))
        for _ in range(300)
    ]
    assert _changes(spark, rows) == _plain(rows)
    assert _changes(spark, rows, per_shard=20) == _plain(rows)


def test_nothing_to_compare(spark):
    assert _changes(spark, []) == []
    assert _changes(spark, [(1, "a", 0, "x", None)]) == []


def test_a_kept_state_finds_the_same_and_keeps_ordinals(spark, tmp_path):
    from lectern.operators.snapshots import advance_snapshot, state_schema
    from lectern.sources.store import TableStore

    rnd = random.Random(9)
    rows = [
        (s, rnd.choice(["a", "b", None]), rnd.choice([0, 1, 2, 3, None]), rnd.choice(["h1", " H1", "h2", None]), dt.datetime(2024, 1, s, rnd.randint(0, 5)))
        for s in range(1, 5)
        for _ in range(9)
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).withColumnRenamed("ordinal", "place")
    keys, value = ["doc", "place"], clean_hash(F.col("h"))
    store, found, seen = TableStore(spark, str(tmp_path / "state")), [], {}
    state = spark.createDataFrame([], state_schema(df, keys, value))
    for night in range(1, 5):
        step = advance_snapshot(state, df.where(F.col("snap") == night), keys, value, "at", shards=3)
        store.publish(store.stage({"state": step}))
        step = store.read("state")
        state = step.where("change IS NULL").drop("change")
        if night > 1:
            found += [(night, r.doc, r.place, r.change) for r in step.where("change IS NOT NULL").collect()]
        now = {(r.doc, r.place): (r.shard, r.ordinal) for r in state.collect()}
        assert all(now[k] == v for k, v in seen.items()) and len(set(now.values())) == len(now)
        seen = now
    assert sorted(found, key=str) == _changes(spark, rows)
    nothing = advance_snapshot(state.where("false"), df.where("false"), keys, value, "at")
    assert nothing.count() == 0
