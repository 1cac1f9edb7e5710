"""One ranking from several scores on unlike scales, by relative closeness to an ideal point.

Each score is winsorised within its group, shifted so that its lower bound is zero and divided by the Euclidean
norm of the group. The ideal point holds the best value of every score, the anti-ideal point the worst. Items are
ordered by ``d(anti) / (d(anti) + d(ideal))``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def present(column: Column) -> Column:
    """The score, or null where it is null or NaN."""
    return F.when(~F.isnan(column), column.cast("double"))


def merge_scores(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]], group: str, item: str) -> DataFrame:
    """One row per (group, item) with the best value of every score; greater is better in all of them.

    The parts are put under each other and combined in one aggregate, which reduces repeated rows
    before the shuffle. Rows without group or item are left out.
    """
    names = list(dict.fromkeys(n for _, scores in parts for n in scores))
    rows = [
        part.select(group, item, *(scores.get(n, F.lit(None)).cast("double").alias(n) for n in names))
        for part, scores in parts
    ]
    stacked = reduce(DataFrame.unionByName, rows).where(F.col(group).isNotNull() & F.col(item).isNotNull())
    return stacked.groupBy(group, item).agg(*(F.max(present(F.col(n))).alias(n) for n in names))


def ideal_point_closeness(
    scored: DataFrame,
    group: str,
    item: str,
    scores: Mapping[str, float],
    lower: float = 0.05,
    upper: float = 0.95,
    accuracy: int = 10_000,
) -> DataFrame:
    """(group, item, closeness) for distinct (group, item); scores maps a column, greater is better, to its weight.

    A missing score counts as the worst of its group. A score that is equal, or missing, for the whole group takes no
    part; where no score takes part the closeness is 0. Bounds and norms are aggregates of each group that combine
    before the shuffle and are joined back, so a group of any size is spread over many tasks. Bounds of groups with
    more than ``accuracy`` items are approximate to one part in it.
    """
    total = sum(scores.values())
    bounds = scored.groupBy(group).agg(
        *(F.percentile_approx(s, [lower, upper], accuracy).alias(f"{s}_q") for s in scores)
    )
    shifted = scored.join(bounds, group).select(
        group,
        item,
        *(
            F.coalesce(
                F.least(F.greatest(F.col(s), F.col(f"{s}_q")[0]), F.col(f"{s}_q")[1]) - F.col(f"{s}_q")[0], F.lit(0.0)
            ).alias(s)
            for s in scores
        ),
    )
    norms = shifted.groupBy(group).agg(
        *(F.sqrt(F.sum(F.col(s) * F.col(s))).alias(f"{s}_n") for s in scores),
        *(F.max(s).alias(f"{s}_m") for s in scores),
    )
    joined = shifted.join(norms, group)

    def squares(of) -> Column:
        return reduce(
            Column.__add__,
            (
                F.when(F.col(f"{s}_n") > 0, F.pow(of(s) / F.col(f"{s}_n"), 2) * (w / total) ** 2).otherwise(0.0)
                for s, w in scores.items()
            ),
        )

    near, far = squares(lambda s: F.col(f"{s}_m") - F.col(s)), squares(lambda s: F.col(s))
    return joined.select(group, item, F.sqrt(near).alias("near"), F.sqrt(far).alias("far")).select(
        group, item, F.when(F.col("near") + F.col("far") > 0, F.col("far") / (F.col("near") + F.col("far"))).otherwise(0.0).alias("closeness")
    )


def best_of_group(ranked: DataFrame, limits: DataFrame, group: str, item: str, limit: str) -> DataFrame:
    """The first ``limit`` items of each group, with their rank from 1; ties go to the smaller item.

    limits has one row per group; a null limit, or no row, gives nothing. The greatest limit is one number for the
    driver; it lets each task drop what can't be among the first before the shuffle.
    """
    most = limits.agg(F.max(limit)).first()[0] or 0
    order = Window.partitionBy(group).orderBy(F.desc("closeness"), item)
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(int(most)))
    return top.join(limits.select(group, limit), group).where(F.col("rank") <= F.col(limit)).drop(limit)
