"""Command line over a store: every command prints one JSON object a line; the exit code is 0, or 1 with the error's record."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import Thresholds, load_config, save_thresholds
from lectern.engine import Engine, as_json
from lectern.errors import ConfigError, LecternError
from lectern.plans import evaluation
from lectern.plans.report import render
from lectern.session import local_session
from lectern.sources.files import read_cases, read_files


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lectern", description=__doc__)
    out.add_argument("--store", required=True)
    out.add_argument("--config", help="settings as a JSON file")
    out.add_argument("--thresholds", help="calibrated bars as a JSON file")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("path")
    commands.add_parser("delete").add_argument("doc_id", nargs="+")
    ask = commands.add_parser("ask")
    ask.add_argument("question", nargs="+")
    ask.add_argument("--debug", action="store_true")
    for name in ("documents", "reconcile", "rebuild", "check-storage", "compact"):
        commands.add_parser(name)
    for name in ("calibrate", "eval"):
        commands.add_parser(name).add_argument("cases", help="cases as JSON lines")
    return out


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _observed(engine: Engine, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with what was answered and measured, and the golds of all cases."""
    asked = cases.select(F.col("id").alias("question_id"), "question")
    answers = engine.ask(asked, debug=True).select(F.col("question_id").alias("case_id"), "status", "citations", "debug")
    golds = cases.select(F.col("id").alias("case_id"), F.posexplode("gold").alias("gold_id", "g")).select("case_id", "gold_id", F.col("g.doc").alias("doc"), F.col("g.must_contain").alias("phrase"))
    texts = engine.job.visible_chunks().join(engine.job.documents().select("doc_id", F.col("source_name").alias("doc")), "doc_id").select("chunk_id", "doc", "text")
    found = answers.select("case_id", F.inline("debug.candidates")).join(texts, "chunk_id").select("case_id", "rank", "doc", "text")
    cited = answers.select("case_id", F.inline("citations")).select("case_id", "excerpt")
    split = cases.select(F.col("id").alias("case_id"), "split", (F.coalesce(F.size("gold"), F.lit(0)) > 0).alias("answerable"))
    out = split.join(answers.select("case_id", (F.col("status") == "answered").alias("answered"), "debug.gate.*"), "case_id")
    return out.join(evaluation.hit_ranks(evaluation.gold_ranks(golds, found)), "case_id", "left").join(evaluation.gold_quoted(golds, cited), "case_id", "left"), golds


def run(spark: SparkSession, arguments: Sequence[str]) -> list[dict] | str:
    """The result of a command: records, or a text for ``eval``."""
    given = _parser().parse_args(arguments)
    config = load_config(given.config) if given.config else None
    engine = Engine.open(spark, given.store, config=config, thresholds_path=given.thresholds)
    job = engine.job
    if given.command == "ingest":
        return _rows(job.ingest(read_files(spark, given.path)))
    if given.command == "delete":
        return _rows(job.delete(given.doc_id))
    if given.command == "ask":
        questions = spark.createDataFrame([(str(i), q) for i, q in enumerate(given.question, start=1)], "question_id string, question string")
        return [{"question_id": r["question_id"], **json.loads(r["response"])} for r in as_json(engine.ask(questions, debug=given.debug)).orderBy("question_id").collect()]
    if given.command == "documents":
        return _rows(job.documents().where("status = 'active'").orderBy("doc_id"))
    if given.command in ("reconcile", "rebuild"):
        found = job.reconcile().groupBy("finding").count().collect()
        return [{"finding": r["finding"], "count": r["count"]} for r in found]
    if given.command == "check-storage":
        return [engine.check()]
    if given.command == "compact":
        return [{"table": name, "version": job.store.compact(name)} for name in sorted(job.store.pointer()["tables"])]
    observed, _ = _observed(engine, read_cases(spark, given.cases))
    if given.command == "eval":
        parts = {"All cases": evaluation.case_metrics(observed), "By split": evaluation.case_metrics(observed, "split")}
        return render("Evaluation", parts, [f"Thresholds version {engine.thresholds.version} of {engine.job.model_id}."])
    if not given.thresholds:
        raise ConfigError("calibrate needs --thresholds, the file to write")
    signals = observed.where("split = 'dev'").select("answerable", "max_dense", "token_coverage")
    best = evaluation.choose(evaluation.grid_search(signals, evaluation.lattice(spark))).first()
    if best is None:
        raise ConfigError("no point of the lattice refuses every unanswerable case")
    bars = Thresholds(best["min_dense"], best["min_coverage"], best["min_coverage_high"], model_id=job.model_id)
    return [vars(save_thresholds(given.thresholds, bars))]


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; the exit code."""
    try:
        out = run(spark or local_session(), sys.argv[1:] if arguments is None else arguments)
    except LecternError as problem:
        print(json.dumps(problem.envelope()))
        return 1
    print(out if isinstance(out, str) else "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in out))
    return 0
