"""Query on the nightly snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.snapshots import advance_snapshot, clean_hash, snapshot_changes, state_schema
from lectern.plans.registry import CORE
from lectern.session import checkpointed, table

P6_SQL = """
WITH latest AS (
  SELECT snapshot_no, doc_id, ordinal,
         lower(regexp_replace(chunk_hash, '^\\s+|\\s+$', '', 'g')) AS h
  FROM eligible_snapshots
  QUALIFY row_number() OVER (
    PARTITION BY snapshot_no, doc_id, ordinal
    ORDER BY taken_at DESC NULLS LAST, lower(regexp_replace(chunk_hash, '^\\s+|\\s+$', '', 'g')) DESC NULLS LAST) = 1
), nights AS (
  SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT snapshot_no FROM eligible_snapshots)
), now_side AS (
  SELECT n.snapshot_no, l.doc_id, l.ordinal, l.h FROM nights n JOIN latest l USING (snapshot_no) WHERE n.before IS NOT NULL
), then_side AS (
  SELECT n.snapshot_no, l.doc_id, l.ordinal, l.h FROM nights n JOIN latest l ON l.snapshot_no = n.before
)
SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.doc_id, b.doc_id) AS doc_id,
       coalesce(a.ordinal, b.ordinal) AS ordinal,
       CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now_side a FULL JOIN then_side b
  ON a.snapshot_no = b.snapshot_no AND a.doc_id = b.doc_id AND a.ordinal = b.ordinal
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h IS DISTINCT FROM b.h
"""


@CORE.query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records added, removed or changed since the night before, for every night after the first."""
    changes = snapshot_changes(
        table(spark, folder, "eligible_snapshots"),
        snapshot="snapshot_no",
        keys=["doc_id", "ordinal"],
        value=clean_hash(F.col("chunk_hash")),
        delivered="taken_at",
    )
    return changes.select(F.col("snapshot").alias("snapshot_no"), "doc_id", "ordinal", "change")


@CORE.query("p6_nightly", P6_SQL)
def p6_nightly(spark: SparkSession, folder: str) -> DataFrame:
    """The same changes found night by night from a kept state, as a nightly job would: each step reads the state and one snapshot."""
    rows = table(spark, folder, "eligible_snapshots").withColumnRenamed("ordinal", "place")  # the state has an ordinal of its own
    keys, value = ["doc_id", "place"], clean_hash(F.col("chunk_hash"))
    state = spark.createDataFrame([], state_schema(rows, keys, value))
    nights = sorted(r["snapshot_no"] for r in rows.select("snapshot_no").distinct().where("snapshot_no IS NOT NULL").collect())
    out = None
    for night in nights:  # one a delivery
        step = checkpointed(advance_snapshot(state, rows.where(F.col("snapshot_no") == night), keys, value, "taken_at"))
        state = step.where("change IS NULL").drop("change")
        found = step.where("change IS NOT NULL").select(F.lit(night).alias("snapshot_no"), "doc_id", F.col("place").alias("ordinal"), "change")
        if night != nights[0]:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "snapshot_no int, doc_id string, ordinal int, change string")
