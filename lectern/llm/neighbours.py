"""Most similar vectors for every vector, by one navigable small-world graph per shard.

A shard is a cell of a coarse clustering whose centres are fitted on a bounded sample. Each vector is stored in the few
cells whose centres are most like it, so that it shares a cell with most of its neighbours; a cell's graph is built in
one task, which also yields the nearest of each of its vectors within the cell. The results of a vector's cells are
merged. The number of cells follows the number of vectors, so that cells, tasks and the work for a vector stay
of one size, and no vector meets a graph of another part of the space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.hnsw import Graph
from lectern.session import checkpointed

#: Vectors of a space from which the centres of its cells are fitted: at most this many, and this many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 32_000_000
#: Sampled vectors that a centre needs; beyond as many cells as the sample allows, cells grow.
SAMPLE_PER_CELL = 50
#: Parts that the keys of a much repeated vector are spread over in a join.
SALTS = 32


def usable(vector: Column, dim: Column) -> Column:
    """Whether a vector has the stated length, no null, NaN or infinite value, and is not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & (dim > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def usable_vectors(rows: DataFrame, space: str, key: str, vector: str, dim: str, created: str) -> DataFrame:
    """(space, dim, key, vector, at) of all rows with a usable vector and neither key nor space null."""
    good = rows.where(usable(F.col(vector), F.col(dim)) & F.col(key).isNotNull() & F.col(space).isNotNull())
    return good.select(F.col(space).alias("space"), F.col(dim).cast("int").alias("dim"), F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(created).alias("at"))


def latest_vectors(good: DataFrame) -> DataFrame:
    """(space, dim, key, vector): of usable vectors the one of each key and space stored last; equal times go to the greater."""
    best = F.max(F.struct("at", "dim", "vector")).alias("best")
    return good.groupBy("space", "key").agg(best).select("space", "best.dim", "key", "best.vector")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of unit length, rounded so that copies of a vector at any scale become equal."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(x, 7).astype(np.float32) + np.float32(0)  # no negative zero


def _copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of every distinct row, number of the distinct row of each row)."""
    flat = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, of = np.unique(flat, return_index=True, return_inverse=True)
    return first, of.ravel()


def _digest(row: np.ndarray) -> bytes:
    return hashlib.blake2b(row.tobytes(), digest_size=16).digest()


def cell_centres(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of a spherical k-means of unit vectors; fewer where there are fewer distinct vectors."""
    x = x[np.sort(_copies(x)[0])]
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 4096] @ centres.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def _fitted(vectors: DataFrame, per_cell: int, copies: int) -> dict[str, tuple[int, int, np.ndarray]]:
    """"dim space" → (first cell number, dim, centres), by counts of all rows and a bounded sample spread by a hash of the key."""
    counts = vectors.groupBy("space", "dim").count().orderBy("space", "dim").collect()  # a row for each model
    out, first = {}, 0
    for r in counts:
        space, dim, n = r["space"], r["dim"], r["count"]
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dim)))
        cells = max(1, min(-(-n * copies // per_cell) if n > per_cell else 1, most // SAMPLE_PER_CELL))
        centres = np.zeros((1, dim), dtype=np.float32)
        if cells > 1:
            every = max(1, n // min(most, cells * 4 * SAMPLE_PER_CELL))
            mine = vectors.where((F.col("space") == space) & (F.col("dim") == dim) & (F.pmod(F.xxhash64("key"), F.lit(every)) == 0))
            taken = mine.select("vector").limit(2 * most).toArrow()
            centres = cell_centres(_matrix(taken["vector"], dim), cells) if taken.num_rows else centres
        out[f"{dim} {space}"] = (first, dim, centres)
        first += len(centres)
    return out


def _emitted(held: dict[bytes, list], x: np.ndarray, keys: list, keep: int) -> tuple[np.ndarray, dict[int, bytes]]:
    """(mask of the rows that go to the cells, digest of the others): of a vector repeated in a batch only rows with fewer
    than ``keep`` smaller keys so far."""
    mask, digests = np.ones(len(x), dtype=bool), {}
    first, of = _copies(x)
    size = np.bincount(of, minlength=len(first))
    for c in np.flatnonzero(size > 1).tolist():
        name = _digest(x[first[c]])
        best = held.setdefault(name, [])
        for i in sorted(np.flatnonzero(of == c).tolist(), key=keys.__getitem__):
            if len(best) >= keep and best[-1] < keys[i]:
                mask[i], digests[i] = False, name
            else:
                best.append(keys[i])
                best.sort()
                del best[keep:]
    return mask, digests


def _placed(vectors: DataFrame, models: dict[str, tuple[int, int, np.ndarray]], kind: str, k: int, copies: int) -> DataFrame:
    """(cell, key, vector) of every vector for each of its cells; keys of a much repeated vector beyond the ``k + 1`` smallest
    come with cell -1, without the vector but with its digest. One row with the digest alone tells the nearest cell of it."""
    held = vectors.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated: dict[str, dict[bytes, list]] = {}
        told: set[tuple[str, bytes]] = set()
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(names.dictionary.to_pylist()):
                part = batch.take(pa.array(np.flatnonzero(codes == code)))
                first, dim, centres = held.value[name]
                x, keys = _matrix(part.column(2), dim), part.column(1)
                mask, digests = _emitted(repeated.setdefault(name, {}), x, keys.to_pylist(), k + 1)
                own = np.flatnonzero(mask)
                near = x[own] @ centres.T
                m = min(copies, len(centres))
                cells = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(centres) else np.broadcast_to(np.arange(m), (len(own), m))
                row = np.repeat(own, m)
                rest = np.array(sorted(digests), dtype=np.int64)
                signs = [i for d, i in {d: i for i, d in digests.items()}.items() if (name, d) not in told]
                told.update((name, digests[i]) for i in signs)
                home = (x[signs] @ centres.T).argmax(1) + first if signs else []
                full, light, alone = len(row), len(rest), len(signs)
                at = np.r_[row, rest, signs].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[cells.ravel() + first, np.full(light, -1), home].astype(np.int32)),
                        keys.take(pa.array(at, mask=np.arange(len(at)) >= full + light)),
                        part.column(2).take(pa.array(at, mask=np.arange(len(at)) >= full)),
                        pa.array([None] * full + [digests[i] for i in at[full:].tolist()], pa.binary()),
                        pa.array([name] * len(at), pa.string()),
                    ],
                    names=["cell", "key", "vector", "digest", "name"],
                )

    named = vectors.select(F.concat_ws(" ", F.col("dim").cast("string"), "space").alias("name"), "key", "vector")
    return named.mapInArrow(run, f"cell int, key {kind}, vector array<float>, digest binary, name string")


def _within(x: np.ndarray, asked: set[bytes], k: int, links: int, ef: int) -> tuple[np.ndarray, np.ndarray, dict[bytes, np.ndarray]]:
    """(positions, similarities) of the ``k`` nearest other rows of each, padded with -1, and the ``k`` first rows of every
    vector asked for by its digest. Each distinct vector is one node of the graph."""
    first, of = _copies(x)
    _, near, sims = Graph.build(x[first], k, links, ef, searched=False)
    order = np.argsort(of, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(first)))]
    single = np.diff(starts) == 1
    plain = single & np.where(near >= 0, single[np.maximum(near, 0)], True).all(1)
    ids = np.where(near >= 0, order[starts[:-1]][np.maximum(near, 0)], -1)[of]
    values, groups = sims[of], {}
    for i in np.flatnonzero(~plain[of]).tolist():  # copies, and neighbours of copies
        c = of[i]
        own = order[starts[c] : min(starts[c + 1], starts[c] + k + 1)]
        others = [j for j in own.tolist() if j != i][:k]
        like = [1.0] * len(others)
        for d, s in zip(near[c].tolist(), sims[c].tolist()):
            if d >= 0 and len(others) < k:
                more = order[starts[d] : min(starts[d + 1], starts[d] + k - len(others))].tolist()
                others += more
                like += [s] * len(more)
        ids[i], values[i] = -1, 0
        ids[i, : len(others)], values[i, : len(others)] = others, like
        if asked and len(own) > k and (name := _digest(x[i])) in asked:
            groups[name] = own[:k]
    return ids, values, groups


def nearest_vectors(
    vectors: DataFrame,
    k: int = 5,
    least: float = -1.0,
    links: int = 16,
    ef: int = 36,
    per_cell: int = 4_096,
    copies: int = 3,
    like: DataFrame | None = None,
) -> DataFrame:
    """(space, dim, key, other, similarity, rank): for each vector the ``k`` most similar others of its space and length, as
    far as their similarity is ``least`` or more.

    vectors has distinct (space, key) with columns space, dim, key and vector, all usable. Similarity is the cosine;
    ties of rank go to the smaller key. A vector alone in its space has no row. The result is approximate: ``ef`` is the
    width of the search, ``links`` the number of links that a node gives, ``copies`` the number of cells that hold
    a vector and ``per_cell`` the vectors a cell holds on average. Spaces, of which there are few, are counted on the driver.
    ``like`` are rows of the same columns by which the cells are counted and fitted, such as the rows from which
    vectors were picked, where these are cheaper to read.

    Copies of a vector are one node. Of their keys only those that can be among the ``k`` nearest of any other are
    sent to the cells; the rest get their neighbours, copies too, by a salted join on the vector's digest.
    """
    kind = vectors.schema["key"].dataType.simpleString()
    models = _fitted(vectors if like is None else like, per_cell, copies)
    if not models:
        empty = f"space string, dim int, key {kind}, other {kind}, similarity double, rank int"
        return vectors.sparkSession.createDataFrame([], empty)
    cells = sum(len(c) for _, _, c in models.values())
    placed = _placed(vectors, models, kind, k, copies)
    spread = placed.where("cell >= 0").drop("name").repartition(max(8, cells), "cell")

    ends = [(first + len(c), name, dim) for name, (first, dim, c) in models.items()]

    def build(rows: pa.Table) -> pa.Table:
        name, dim = next((n, d) for last, n, d in ends if rows["cell"][0].as_py() < last)
        asked = set(rows["digest"].drop_null().to_pylist())
        rows = rows.filter(pc.is_valid(rows["key"])).sort_by("key")
        keys = rows["key"].combine_chunks()
        ids, sims, groups = _within(_matrix(rows["vector"], dim), asked, k, links, ef)
        good = (ids >= 0) & (sims >= least)
        sizes = good.sum(1)
        row = np.flatnonzero(sizes)
        at = pa.array(np.r_[0, np.cumsum(sizes[row])].astype(np.int32))
        others = pa.ListArray.from_arrays(at, keys.take(pa.array(ids[good])))
        values = pa.ListArray.from_arrays(at, pa.array(np.clip(sims[good].astype(np.float64), -1, 1)))
        found = {"key": keys.take(pa.array(row)), "others": others, "sims": values, "digest": pa.nulls(len(row), pa.binary())}
        if groups:
            held = {
                "key": pa.nulls(len(groups), keys.type), "others": pa.array([keys.take(pa.array(g)).to_pylist() for g in groups.values()], pa.list_(keys.type)),
                "sims": pa.array([[1.0] * len(g) for g in groups.values()], pa.list_(pa.float64())), "digest": pa.array(list(groups), pa.binary()),
            }
            found = {c: pa.concat_arrays([found[c].cast(held[c].type), held[c]]) for c in found}
        n = len(found["key"])
        return pa.table(found | {"name": pa.array([name] * n, pa.string())})

    schema = f"key {kind}, others array<{kind}>, sims array<double>, digest binary, name string"
    built = checkpointed(spread.groupBy("cell").applyInArrow(build, schema))  # read three times below
    found = built.where("digest IS NULL").select("name", "key", "others", "sims")
    told = built.where("digest IS NOT NULL")
    if not told.isEmpty():
        rest = placed.where("cell < 0").select("name", "digest", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
        groups = told.groupBy("name", "digest").agg(F.first("others").alias("others"), F.first("sims").alias("sims"))
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.unionByName(rest.join(salted, ["name", "digest", "salt"]).select("name", "key", "others", "sims"))
    return _merged(found, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every key out of the lists of its cells; a pair found in several cells counts once.

    The lists of a key, at most one a cell, are shuffled as they are and merged as arrays.
    """
    pair = lambda p: F.struct(p["others"].alias("other"), (-p["sims"]).alias("far"))
    lists = found.groupBy("name", "key").agg(F.flatten(F.collect_list(F.arrays_zip("others", "sims"))).alias("all"))
    by_other = lists.select("name", "key", F.array_sort(F.transform("all", pair)).alias("pairs"))
    once = F.filter("pairs", lambda p, i: (i == 0) | ~p["other"].eqNullSafe(F.get("pairs", i - 1)["other"]))
    best = F.slice(F.array_sort(F.transform(once, lambda p: F.struct(p["far"].alias("far"), p["other"].alias("other")))), 1, k)
    ranked = by_other.select("name", "key", F.posexplode(best).alias("nth", "best"))
    named = F.split("name", " ", 2)
    return ranked.select(
        named[1].alias("space"), named[0].cast("int").alias("dim"), "key", F.col("best.other").alias("other"), (-F.col("best.far")).alias("similarity"), (F.col("nth") + 1).alias("rank")
    )


def mutual_pairs(nearest: DataFrame, least: float) -> DataFrame:
    """(space, a, b, similarity), a < b: pairs of which each is among the nearest of the other, from that similarity on."""
    close = nearest.where((F.col("similarity") >= least) & (F.col("key") != F.col("other")))
    sided = close.groupBy("space", "dim", F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
    both = sided.agg(F.count_distinct("key").alias("sides"), F.max("similarity").alias("similarity"))
    return both.where("sides = 2").select("space", "a", "b", "similarity")
