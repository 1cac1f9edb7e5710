"""What changed between consecutive full snapshots of a table.

Every record key gets a persistent ordinal within its shard. A snapshot is then a compressed bitmap of the
ordinals it holds and a vector of compared values aligned to the ordinals. AND-NOT of neighbouring bitmaps gives
the additions and the removals, a comparison of the vectors at the common ordinals gives the changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.bitmap import Bitmap

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def clean_hash(column: Column) -> Column:
    """A hash without the differences that do not count: letter case and surrounding white space."""
    return F.lower(F.regexp_replace(column, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))


def latest_delivery(rows: DataFrame, snapshot: str, keys: list[str], value: Column, delivered: str) -> DataFrame:
    """One row per (snapshot, key): the one delivered last.

    Equal delivery times are settled by the greater value, a null time loses to any other, null keys are
    keys like others. The aggregate combines before the shuffle, so a key with very many repeats is no hot group.
    """
    best = F.max(F.struct(F.col(delivered).alias("at"), value.alias("value"))).getField("value")
    return rows.groupBy(F.col(snapshot).alias("snapshot"), *(F.col(k) for k in keys)).agg(best.alias("value"))


def assign_ordinals(first_seen: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rank of each distinct key by the snapshot in which it first came, then by the key.

    A later snapshot only appends: the ordinals given before never move.
    """
    order = np.lexsort((*reversed(keys), first_seen))
    ordinals = np.empty(len(order), dtype=np.int64)
    ordinals[order] = np.arange(len(order))
    return ordinals


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Codes of the distinct values, in the values' order; null has code -1."""
    encoded = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    encoded = encoded.dictionary_encode()
    rank = pc.rank(encoded.dictionary, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    indices = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)
    return np.where(indices < 0, -1, rank[np.maximum(indices, 0)] - 1 if len(rank) else -1)


def _shard_changes(rows: pa.Table, keys: list[str], snapshots: list[int]) -> pa.Table:
    codes = [_codes(rows[k]) for k in keys]
    nights = rows["snapshot"].to_numpy()
    values = _codes(rows["value"])
    packed = codes[0].astype(np.int64)
    for c in codes[1:]:
        packed = packed * (int(c.max(initial=0)) + 2) + c + 1
    _, first_row, key_of = np.unique(packed, return_index=True, return_inverse=True)
    first_seen = np.full(len(first_row), np.iinfo(np.int64).max)
    np.minimum.at(first_seen, key_of, nights)
    ordinals = assign_ordinals(first_seen, *(c[first_row] for c in codes))
    row_of = np.empty(len(first_row), dtype=np.int64)
    row_of[ordinals] = first_row
    ordinal = ordinals[key_of]

    maps, vectors = {}, {}
    for night in snapshots:
        here = nights == night
        maps[night] = Bitmap.of(ordinal[here])
        vectors[night] = np.full(len(first_row), -2, dtype=np.int64)
        vectors[night][ordinal[here]] = values[here]
    found: list[tuple[int, str, np.ndarray]] = []
    for before, night in zip(snapshots, snapshots[1:]):
        found.append((night, ADDED, maps[night].andnot(maps[before]).ordinals()))
        found.append((night, REMOVED, maps[before].andnot(maps[night]).ordinals()))
        both = maps[night].and_(maps[before]).ordinals()
        found.append((night, CHANGED, both[vectors[night][both] != vectors[before][both]]))
    at = np.concatenate([o for _, _, o in found]) if found else np.empty(0, dtype=np.int64)
    out = {
        "snapshot": pa.array(np.repeat([n for n, _, _ in found], [len(o) for _, _, o in found]), pa.int32()),
        **{k: rows[k].take(pa.array(row_of[at])) for k in keys},
        "change": pa.array([c for _, c, o in found for _ in range(len(o))], pa.string()),
    }
    return pa.table(out)


def snapshot_changes(
    rows: DataFrame,
    snapshot: str,
    keys: list[str],
    value: Column,
    delivered: str,
    rows_per_shard: int = 200_000,
) -> DataFrame:
    """Records added, removed or changed in every snapshot but the first, against the one before it.

    Columns: ``snapshot``, the keys, ``change``. Several rows of one record in a snapshot count as the one delivered
    last. Null keys are records of their own; a null value equals only null. A record gone for a night and back is
    removed, then added. No rows, or one snapshot, give an empty result; further columns are ignored.

    Records are spread over shards by a hash of the whole key, so that no source or document makes a hot shard;
    the number of shards follows the row count. The numbers of the snapshots, one for each delivery, are
    collected; nothing else comes to the driver.
    """
    named = [(k, f"key_{i}") for i, k in enumerate(keys)]
    picked = rows.select(
        F.col(snapshot).cast("int").alias("snapshot"),
        *(F.col(k).alias(alias) for k, alias in named),
        value.alias("value"),
        F.col(delivered).alias("delivered"),
    ).where(F.col("snapshot").isNotNull())
    numbers = picked.groupBy("snapshot").count().collect()
    nights = sorted(r["snapshot"] for r in numbers)
    shards = max(1, -(-sum(r["count"] for r in numbers) // rows_per_shard))
    aliases = [alias for _, alias in named]
    latest = latest_delivery(picked, "snapshot", aliases, F.col("value"), "delivered")
    types = {f.name: f.dataType.simpleString() for f in latest.schema.fields}
    schema = "snapshot int, " + ", ".join(f"{a} {types[a]}" for a in aliases) + ", change string"

    def shard(rows: pa.Table) -> pa.Table:
        return _shard_changes(rows, aliases, nights)

    changes = (
        latest.withColumn("shard", F.pmod(F.xxhash64(*aliases), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(lambda t: shard(t.drop_columns(["shard"])), schema)
    )
    return changes.select("snapshot", *(F.col(alias).alias(k) for k, alias in named), "change")


def state_schema(rows: DataFrame, keys: list[str], value: Column) -> str:
    """Schema of the state that ``advance_snapshot`` keeps: shard, keys, ordinal, value, here."""
    types = {f.name: f.dataType.simpleString() for f in rows.select(*keys, value.alias("value")).schema.fields}
    return "shard int, " + ", ".join(f"{k} {types[k]}" for k in keys) + f", ordinal long, value {types['value']}, here boolean"


def advance_snapshot(state: DataFrame, rows: DataFrame, keys: list[str], value: Column, delivered: str, shards: int = 64) -> DataFrame:
    """One night more: (change, shard, keys, ordinal, value, here), the new state where change is null, else what changed.

    The state is a table with one row for each key ever seen, kept from night to night: a key has its ordinal within its shard
    for good, new keys are appended behind the last one, and ``here`` says whether the last snapshot held it. Only the state and the
    new snapshot are read, however many came before. The number of shards belongs to the state and must not change. Rows of a record
    count as in ``snapshot_changes``; an empty state is that before the first snapshot, whose records are all added.
    """
    schema = state_schema(rows, keys, value)
    aliases = [f"key_{i}" for i in range(len(keys))]
    renamed = rows.select(F.lit(0).alias("night"), *(F.col(k).alias(a) for k, a in zip(keys, aliases)), value.alias("value"), F.col(delivered).alias("delivered"))
    latest = latest_delivery(renamed, "night", aliases, F.col("value"), "delivered")
    fresh = latest.select(F.pmod(F.xxhash64(*aliases), F.lit(shards)).cast("int").alias("shard"), *aliases, "value")
    old = state.select("shard", *(F.col(k).alias(a) for k, a in zip(keys, aliases)), "ordinal", "value", "here")

    def shard(held: pa.Table, new: pa.Table) -> pa.Table:
        n, columns = held.num_rows, {}
        both = {c: pa.chunked_array([*held[c].chunks, *new[c].cast(held[c].type).chunks], held[c].type) for c in [*aliases, "value"]}
        codes = [_codes(both[a]) for a in aliases]
        packed = codes[0].astype(np.int64)
        for c in codes[1:]:
            packed = packed * (int(c.max(initial=0)) + 2) + c + 1
        values = _codes(both["value"])
        names, first, of = np.unique(packed, return_index=True, return_inverse=True)
        of = of.ravel()
        ordinal = np.full(len(names), -1, dtype=np.int64)
        ordinal[of[:n]] = held["ordinal"].to_numpy()
        unseen = np.flatnonzero(ordinal < 0)  # in the order of the keys
        ordinal[unseen] = np.arange(len(unseen)) + (ordinal.max(initial=-1) + 1)
        was = np.zeros(len(names), dtype=bool)
        was[of[:n]] = held["here"].to_numpy(zero_copy_only=False)
        before, now = Bitmap.of(ordinal[was]), Bitmap.of(ordinal[of[n:]])
        vectors = np.full((2, len(names)), -2, dtype=np.int64)
        vectors[0][ordinal[of[:n]]], vectors[1][ordinal[of[n:]]] = values[:n], values[n:]
        common = now.and_(before).ordinals()
        found = [(ADDED, now.andnot(before).ordinals()), (REMOVED, before.andnot(now).ordinals()), (CHANGED, common[vectors[0][common] != vectors[1][common]])]
        row_of = np.empty(len(names), dtype=np.int64)
        row_of[ordinal] = first
        last = row_of.copy()  # the row whose value is kept: the new one where there is one
        last[ordinal[of[n:]]] = np.arange(n, n + new.num_rows)
        here = np.zeros(len(names), dtype=bool)
        here[ordinal[of[n:]]] = True
        at = np.concatenate([np.arange(len(names)), *(o for _, o in found)]).astype(np.int64)
        kinds = [None] * len(names) + [k for k, o in found for _ in range(len(o))]
        number = (held if n else new)["shard"][0].as_py()
        columns = {"change": pa.array(kinds, pa.string()), "shard": pa.array(np.full(len(at), number), pa.int32())}
        columns |= {a: both[a].take(pa.array(row_of[at])) for a in aliases}
        columns |= {"ordinal": pa.array(at), "value": both["value"].take(pa.array(last[at])), "here": pa.array(here[at])}
        return pa.table(columns)

    typed = schema
    for k, a in zip(keys, aliases):
        typed = typed.replace(f", {k} ", f", {a} ", 1)
    out = old.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInArrow(shard, "change string, " + typed)
    return out.select("change", "shard", *(F.col(a).alias(k) for a, k in zip(aliases, keys)), "ordinal", "value", "here")
