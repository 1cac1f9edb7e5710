"""The dense arm: exact cosine neighbours of a set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import checkpointed

#: Bytes of query vectors, and of what is kept for them, up to which one block is sent to all workers.
BLOCK_BYTES = 64 * 2**20
#: Products of queries and rows that a worker holds at a time.
PRODUCTS = 1_000_000
#: Rows after which a worker drops the ids that it no longer needs.
ID_ROWS = 500_000


def _unit(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    x = np.asarray(pc.list_flatten(vectors)).astype(np.float64).reshape(-1, dim)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


class Nearest:
    """The ``n`` best rows of a task for every query. Rows come in the order of their ids, so that ties go to those that came first.

    A similarity of nine decimals and the place of the row are one number, the greater the better. Products are formed for so many queries at a
    time that they take ``PRODUCTS`` numbers.
    """

    NONE = np.iinfo(np.int64).min

    def __init__(self, queries: np.ndarray, n: int) -> None:
        self.queries, self.n, self.rows = queries, n, 0
        self.kept, self.similarity = np.full((len(queries), n), self.NONE), np.zeros((len(queries), n))
        self.bar = np.full(len(queries), -np.inf)

    def add(self, vectors: np.ndarray) -> None:
        """Unit vectors of further rows."""
        step = max(1, PRODUCTS // max(1, len(vectors)))
        for a in range(0, len(self.queries), step):
            s = self.queries[a : a + step] @ vectors.T
            query, row = np.nonzero(s >= self.bar[a : a + step, None] - 2e-9)
            if not len(query):
                continue
            hits, count = s[query, row], np.bincount(query, minlength=len(s))
            slot = self.n + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            keys, similarity = np.full((len(s), self.n + count.max()), self.NONE), np.zeros((len(s), self.n + count.max()))
            keys[:, : self.n], similarity[:, : self.n] = self.kept[a : a + step], self.similarity[a : a + step]
            keys[query, slot], similarity[query, slot] = np.rint(hits * 1e9).astype(np.int64) * 2**32 + (2**32 - 1 - self.rows - row), hits
            best = np.argpartition(keys, count.max(), axis=1)[:, count.max() :]
            self.kept[a : a + step], self.similarity[a : a + step] = (np.take_along_axis(x, best, axis=1) for x in (keys, similarity))
            least = self.kept[a : a + step, 0]
            self.bar[a : a + step] = np.where(least == self.NONE, -np.inf, (least >> 32) / 1e9)
        self.rows += len(vectors)

    def places(self) -> np.ndarray:
        """Places of the rows that are kept."""
        return 2**32 - 1 - (np.unique(self.kept[self.kept != self.NONE]) & (2**32 - 1))

    def only(self, places: np.ndarray) -> None:
        """Rows are counted anew as if only those at the places, which are sorted, had come."""
        has = self.kept != self.NONE
        old = self.kept[has]
        self.kept[has] = (old >> 32 << 32) + (2**32 - 1 - np.searchsorted(places, 2**32 - 1 - (old & (2**32 - 1))))
        self.rows = len(places)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of the queries, places and similarities of the rows kept, in pieces."""
        step = max(1, 50_000 // max(1, self.n))
        for a in range(0, len(self.kept), step):
            query, slot = np.nonzero(self.kept[a : a + step] != self.NONE)
            yield a + query, 2**32 - 1 - (self.kept[a + query, slot] & (2**32 - 1)), self.similarity[a + query, slot]


def _nearest(batches: Iterator[pa.RecordBatch], names: pa.Array, queries: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, similarity) of the n best rows of a task for every query, of (id, vector) sorted by id."""
    nearest, ids, vectors, bound = Nearest(queries, n), [], [], ID_ROWS
    for batch in batches:
        if not len(batch):
            continue
        ids.append(batch.column("id"))
        nearest.add(_unit(batch.column("vector"), queries.shape[1]))
        if nearest.rows > bound:  # ids of rows that are not kept are dropped
            places = np.unique(nearest.places())
            nearest.only(places)
            ids = [pa.concat_arrays(ids).take(pa.array(places))]
            bound = len(places) + ID_ROWS
    if not ids:
        return
    held = pa.concat_arrays(ids)
    for query, place, similarity in nearest.found():
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), held.take(pa.array(place)), pa.array(similarity)], ["query_id", "id", "similarity"])


def cosine_topk(queries: DataFrame, corpus: DataFrame, n: int, keep_self: bool = True) -> DataFrame:
    """(query_id, id, similarity, dense_rank): the ``n`` most similar rows of the corpus for every query, exactly.

    queries has query_id and vector, corpus has id and vector, all of one length; null vectors and those of another length than
    most queries are left out, zero vectors have similarity 0. Ties go to the smaller id. Queries are checkpointed and sent to the workers in
    blocks of bounded size, each of which reads the corpus once; a task keeps the best of all its rows for each query, forms no more than
    ``PRODUCTS`` products at a time, and a window merges the tasks' results.
    """
    spark = corpus.sparkSession
    q_kind, id_kind = queries.schema["query_id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    schema = f"query_id {q_kind}, id {id_kind}, similarity double"
    held = checkpointed(queries.where(F.col("vector").isNotNull()).select("query_id", "vector", F.size("vector").alias("dim")))
    lengths = held.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema + ", dense_rank int")
    dim = lengths[0]["dim"]
    blocks = max(1, -(-lengths[0]["count"] * (dim * 8 + n * 16) // BLOCK_BYTES))
    rows = corpus.select("id", "vector").where(F.size("vector") == dim)
    # few tasks, since each returns its best of every query
    rows = rows.coalesce(spark.sparkContext.defaultParallelism).sortWithinPartitions("id")
    out = None
    for block in range(blocks):
        mine = held.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select("query_id", "vector").toArrow()
        if not len(mine):
            continue
        sent = spark.sparkContext.broadcast((pa.concat_arrays(mine["query_id"].chunks), _unit(mine["vector"], dim)))
        best = lambda batches, sent=sent: _nearest(batches, *sent.value, n)
        found = rows.mapInArrow(best, schema)
        out = found if out is None else out.unionByName(found)
    if not keep_self:
        out = out.where(F.col("query_id") != F.col("id"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return out.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= n)
