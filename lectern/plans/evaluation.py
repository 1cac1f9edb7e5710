"""Retrieval metrics, sweeps and calibration as ordinary plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import checkpointed

LATTICE = {"min_dense": (0.0, 1.0, 21), "min_coverage": (0.0, 0.8, 17), "min_coverage_high": (0.0, 1.0, 21)}


def hit_ranks(phrase_ranks: DataFrame) -> DataFrame:
    """(case_id, hit_rank) from (case_id, gold_id, rank): where every gold of a case has been seen; null if one is missing.

    A gold without a rank is a row with a null rank.
    """
    best = phrase_ranks.groupBy("case_id", "gold_id").agg(F.min("rank").alias("rank"))
    missing = F.count_if(F.col("rank").isNull()) > 0
    return best.groupBy("case_id").agg(F.when(~missing, F.max("rank")).alias("hit_rank"))


def retrieval_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Recall at 1, 3 and 5 and reciprocal rank at 5 of (case_id, hit_rank), by the given columns."""
    at = lambda k: F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    mrr = F.avg(F.when(F.col("hit_rank") <= 5, 1.0 / F.col("hit_rank")).otherwise(0.0)).alias("mrr_5")
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), at(1), at(3), at(5), mrr)


def gold_ranks(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case_id, gold_id, rank): the first candidate of the gold's document whose text holds its phrase; null where there is none.

    cases has case_id, gold_id, doc and phrase, candidates has case_id, rank, doc and text. The join is on case and document; only then are
    texts searched, for the phrase as it is.
    """
    met = cases.join(candidates.withColumnRenamed("rank", "place"), ["case_id", "doc"], "left")
    holds = F.contains("text", F.col("phrase"))
    return met.groupBy("case_id", "gold_id").agg(F.min(F.when(holds, F.col("place"))).alias("rank"))


def gold_quoted(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """(case_id, golds, quoted): of the golds of a case, how many phrases stand in an excerpt that its answer cites."""
    met = cases.join(citations.select("case_id", "excerpt"), "case_id", "left")
    held = met.groupBy("case_id", "gold_id").agg(F.coalesce(F.max(F.contains("excerpt", F.col("phrase"))), F.lit(False)).alias("held"))
    return held.groupBy("case_id").agg(F.count("*").alias("golds"), F.count_if("held").alias("quoted"))


def case_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """All rates over (case_id, answerable, answered, hit_rank, golds, quoted), by the given columns.

    Recall and reciprocal rank are over the answerable cases, quoted shares over those of them that were answered: ``quoted_share`` of all
    their golds, ``fully_quoted`` of the cases. A rate without cases is 0.
    """
    yes, told = F.col("answerable"), F.col("answered")
    rate = lambda part, whole: F.coalesce(F.try_divide(F.count_if(part), F.count_if(whole)), F.lit(0.0))
    mrr = F.sum(F.when(yes & (F.col("hit_rank") <= 5), 1.0 / F.col("hit_rank")).otherwise(0.0))
    golds = F.sum(F.when(yes & told, F.col("golds")))
    return cases.groupBy(*by).agg(
        F.count_if(yes).alias("answerable_cases"), F.count_if(~yes).alias("other_cases"),
        *(rate(yes & (F.col("hit_rank") <= k), yes).alias(f"recall_{k}") for k in (1, 3, 5)),
        F.coalesce(F.try_divide(mrr, F.count_if(yes)), F.lit(0.0)).alias("mrr_5"),
        rate(yes & told, yes).alias("answered_rate"), rate(~yes & told, ~yes).alias("false_rate"), F.count_if(~yes & told).alias("false_answers"),
        F.coalesce(F.try_divide(F.sum(F.when(yes & told, F.col("quoted"))), golds), F.lit(0.0)).alias("quoted_share"),
        rate(yes & told & (F.col("golds") > 0) & (F.col("quoted") == F.col("golds")), yes & told).alias("fully_quoted"),
    )


def missed_golds(cases: DataFrame, ranks: DataFrame, citations: DataFrame, top_k: int = 5) -> DataFrame:
    """(case_id, gold_id, cause) of the golds that an answer did not quote.

    ``retrieval``: no citation is of the gold's document. ``answerer``: its chunk was among the first ``top_k``, and its sentence was left
    out. ``truncation``: it stood further down or nowhere. cases are those answered; citations has case_id, doc and excerpt.
    """
    cited = citations.groupBy("case_id", "doc").agg(F.lit(True).alias("cited"))
    quoted = cases.join(citations.select("case_id", "excerpt"), "case_id").where(F.contains("excerpt", F.col("phrase"))).select("case_id", "gold_id").distinct()
    missed = cases.join(quoted, ["case_id", "gold_id"], "left_anti").join(cited, ["case_id", "doc"], "left").join(ranks, ["case_id", "gold_id"], "left")
    cause = F.when(F.col("cited").isNull(), "retrieval").when(F.col("rank") <= top_k, "answerer").otherwise("truncation")
    return missed.select("case_id", "gold_id", cause.alias("cause"))


def regate(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """(config, case_id, passed): the gate's verdict on stored signals under each row of bars (config, min_dense, min_coverage,
    min_coverage_high), a small table; nothing is searched again."""
    each = signals.crossJoin(F.broadcast(bars))
    covered = (F.col("max_dense") >= F.col("min_dense")) & (F.col("token_coverage") >= F.col("min_coverage"))
    passed = (F.col("candidate_count") > 0) & (covered | (F.col("token_coverage") >= F.col("min_coverage_high")))
    return each.select("config", "case_id", passed.alias("passed"))


def stale_leaks(quotes: DataFrame, removed: DataFrame) -> DataFrame:
    """(case_id, phrase) of answers that still quote a phrase which the current version of its document no longer holds.

    quotes has case_id, doc and excerpt, removed has doc and phrase.
    """
    return quotes.join(removed, "doc").where(F.contains("excerpt", F.col("phrase"))).select("case_id", "phrase").distinct()


def gate_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Rates of (answerable, passed): answered of the answerable, false answers of the others, by the given columns."""
    share = lambda c: F.avg(F.when(c, F.col("passed").cast("double")))
    yes = F.col("answerable")
    return cases.groupBy(*by).agg(
        share(yes).alias("answered_rate"), share(~yes).alias("false_rate"), F.count_if(~yes & F.col("passed")).alias("false_answers")
    )


def median_and_percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, median, percentile): exact, for groups of any size; rows with a null value are left out.

    The median is the mean of the two middle values, the percentile the value at position int(n * p) of the sorted values,
    the last at most. Equal values are counted first; the distinct ones are sorted over range partitions, so that
    no task holds a group. Only the sizes of the partitions by group are gathered.
    """
    picked = rows.select(F.col(by).alias("by"), F.col(value).alias("value")).where(F.col("value").isNotNull())
    counts = picked.groupBy("by", "value").agg(F.count("*").alias("n"))
    ranged = checkpointed(counts.repartitionByRange("by", "value").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("by", "part").agg(F.sum("n").alias("size"))
    everything = Window.partitionBy("by")
    before = F.sum("size").over(everything.orderBy("part")) - F.col("size")
    starts = sizes.select(F.col("by").alias("of"), F.col("part").alias("in"), before.alias("before"), F.sum("size").over(everything).alias("total"))
    placed = ranged.join(F.broadcast(starts), F.col("by").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))  # a row a partition and group
    until = F.col("before") + F.sum("n").over(Window.partitionBy("by", "part").orderBy("value"))
    spans = placed.withColumn("until", until).withColumn("since", F.col("until") - F.col("n"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("since") <= position) & (position < F.col("until")), F.col("value")))

    total = F.col("total")
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    last = F.least(total - 1, F.floor(total * F.lit(p)))
    found = spans.groupBy("by").agg(at(low).alias("low"), at(high).alias("high"), at(last).alias("percentile"))
    return found.select(F.col("by").alias(by), (F.col("low") * 0.5 + F.col("high") * 0.5).alias("median"), "percentile")


def lattice(spark) -> DataFrame:
    """All points of the three bars with the high one not below the low one."""
    points = None
    for name, (low, high, n) in LATTICE.items():
        step = (high - low) / (n - 1)
        axis = spark.range(n).select(F.round(F.lit(low) + F.col("id") * step, 6).alias(name))
        points = axis if points is None else points.crossJoin(axis)
    return points.where("min_coverage_high >= min_coverage")


def grid_search(signals: DataFrame, points: DataFrame) -> DataFrame:
    """Rates of every point over (answerable, max_dense, token_coverage): one pass over the signals for the whole lattice.

    Signals are counted on the lattice first: the bars a question just reaches decide its verdict at every point,
    so the join is of the lattice with the few distinct cells, however many questions there are.
    """
    d, c, h = (LATTICE[k] for k in ("min_dense", "min_coverage", "min_coverage_high"))

    def reached(value: Column, axis) -> Column:
        low, high, n = axis
        step = (high - low) / (n - 1)
        return F.least(F.lit(n - 1), F.floor((value - low) / step + 1e-9)).cast("int")

    cells = signals.groupBy(
        "answerable", reached(F.col("max_dense"), d).alias("d"), reached(F.col("token_coverage"), c).alias("c"), reached(F.col("token_coverage"), h).alias("h")
    ).agg(F.count("*").alias("n"))
    at = lambda name, axis: F.round((F.col(name) - axis[0]) / ((axis[1] - axis[0]) / (axis[2] - 1))).cast("int")
    placed = points.withColumns({"pd": at("min_dense", d), "pc": at("min_coverage", c), "ph": at("min_coverage_high", h)})
    both = placed.crossJoin(F.broadcast(cells))  # cells are bounded by the lattice, two for each of its points
    passed = ((F.col("d") >= F.col("pd")) & (F.col("c") >= F.col("pc"))) | (F.col("h") >= F.col("ph"))
    yes = F.col("answerable")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return both.groupBy(*LATTICE).agg(
        total(yes & passed).alias("answered"), total(yes).alias("answerable"), total(~yes & passed).alias("false_answers")
    )


def choose(grid: DataFrame) -> DataFrame:
    """The feasible point, without a false answer, that answers most; of several the one nearest to the middle of all
    feasible ones, then the first. No row if none is feasible."""
    feasible = grid.where("false_answers = 0")
    middle = feasible.agg(*(F.avg(n).alias(f"mid_{n}") for n in LATTICE))
    spread = sum(((F.col(n) - F.col(f"mid_{n}")) ** 2 for n in LATTICE), F.lit(0.0))
    ranked = feasible.crossJoin(F.broadcast(middle)).withColumn("distance", F.round(F.sqrt(spread), 9))  # one row
    return ranked.orderBy(F.desc("answered"), "distance", *LATTICE).limit(1).select(*LATTICE, "answered", "answerable", "false_answers")
