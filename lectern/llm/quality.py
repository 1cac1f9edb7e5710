"""Per-document text statistics, and from these whether a document is prose.

Statistics are computed for every document where it is read. Gradient-boosted trees are trained on the statistics of a
bounded sample. Its labels are weak: functions vote on the texts by evidence that is no statistic of the model, and texts on
which they disagree or are silent are left out. The probabilities are calibrated on a holdout of documents of the corpus that
were labelled by hand from excerpts; of these the statistics are kept, with a hash of the text.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.boosting import BoostedTrees, boost
from lectern.llm.textstats import STATISTICS, statistics
from lectern.llm.weaklabels import weak_label

HOLDOUT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "holdout.csv")


def holdout() -> tuple[np.ndarray, np.ndarray]:
    """(statistics, 1 for prose and 0 for junk) of the documents labelled by hand."""
    with open(HOLDOUT, encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    return np.array([[float(r[s]) for s in STATISTICS] for r in rows]), np.array([float(r["prose"]) for r in rows])


def _columns(x: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c)) for c in x.T]


def labelled_sample(rows: DataFrame, text: str, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, weak label) of those with a label of about ``sample_rows`` rows, drawn by chance, whatever keys repeat."""
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.select(F.col(text).alias("text")).sample(share, seed=0).where(F.length("text") > 0)
    sample = sample.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # few rows of one file are labelled by all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            labels = np.array([weak_label(t) for t in texts], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(labels), *_columns(statistics(texts))], names=["label", *STATISTICS])

    fields = ", ".join(f"{s} double" for s in STATISTICS)
    taken = sample.mapInArrow(run, f"label int, {fields}").where("label >= 0").toPandas().to_numpy(dtype=np.float64)
    taken = taken[np.lexsort(taken.T[::-1])] if len(taken) else np.zeros((0, 1 + len(STATISTICS)))
    return taken[:, 1:], taken[:, 0]


def train(rows: DataFrame, text: str, sample_rows: int = 6_000) -> BoostedTrees:
    """Trees trained on a weakly labelled sample of about ``sample_rows`` rows and calibrated on the holdout."""
    x, y = labelled_sample(rows, text, sample_rows)
    model = boost(x, y, trees=60, depth=3)
    model.calibrate(*holdout())
    return model


def text_quality(rows: DataFrame, key: str, text: str, model: BoostedTrees | None = None) -> DataFrame:
    """(key, each of ``STATISTICS``, prose) of every row, in one pass and without a shuffle.

    ``prose`` is the calibrated probability that most of the text is prose; null for a text that is null or without a visible
    character, whose statistics are 0, and null without a model. Further columns are dropped, repeated rows stay.
    """
    kind = rows.schema[key].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the number and depth of the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1).to_pylist())
            if held.value is None:
                prose = pa.nulls(len(x), pa.float64())
            else:
                prose = pa.array(held.value.probability(x), pa.float64(), mask=x[:, STATISTICS.index("log_chars")] <= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(x), prose], names=["key", *STATISTICS, "prose"])

    picked = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    fields = ", ".join(f"{s} double" for s in STATISTICS)
    return picked.mapInArrow(run, f"key {kind}, {fields}, prose double").withColumnRenamed("key", key)
