"""Documents to contiguous, overlapping, hashed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.config import EngineConfig
from lectern.functions import identity, text as t

SPANS = "array<struct<start:int,end:int>>"


def packed_spans(sentences: Column, config: EngineConfig) -> Column:
    """Greedy packing of sentences: a chunk ends before the sentence with which it would exceed the target, and the next
    one starts up to the overlap earlier."""
    zero = F.struct(F.array().cast(SPANS).alias("out"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["end"] > acc["start"]) & (acc["end"] - acc["start"] + F.length(s["text"]) > config.target_chars)
        span = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.struct(
            F.when(full, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"),
            F.when(full, F.greatest(acc["start"], acc["end"] - config.overlap_chars)).otherwise(acc["start"]).alias("start"),
            s["end"].alias("end"),
        )

    def finish(acc: Column) -> Column:
        span = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["end"] > acc["start"], F.concat(acc["out"], span)).otherwise(acc["out"])

    return F.aggregate(sentences, zero, step, finish)


def capped_spans(spans: Column, length: Column, config: EngineConfig) -> Column:
    """Spans above the hard size cut into overlapping windows; a tail left over is added from the last start."""
    hard, step = config.hard_chars, max(1, config.hard_chars - config.overlap_chars)
    cut = F.flatten(
        F.transform(
            spans,
            lambda s: F.when(s["end"] - s["start"] <= hard, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(
                F.transform(
                    F.sequence(s["start"], F.greatest(s["start"], s["end"] - 1), F.lit(step)),
                    lambda c: F.struct(c.alias("start"), F.least(c + hard, s["end"]).alias("end")),
                )
            ),
        )
    )
    last = F.try_element_at(cut, F.lit(-1))
    tail = F.array(F.struct(last["start"].alias("start"), length.alias("end")))
    return F.when(last["end"] < length, F.concat(cut, tail)).otherwise(cut)


def chunk_sections(sections: DataFrame, config: EngineConfig | None = None, hashes: bool = True) -> DataFrame:
    """(doc_id, ordinal, char_start, char_end, text, section_path, language, pages, lines, chunk_hash).

    sections has doc_id, section_no, char_start, body, section_path, page_start, page_end, line_start and line_end; offsets count code
    points of the document. Chunks never cross a section; blank sections and chunks are left out, ordinals are dense
    over the document. A null body counts as blank. The fold over the sentences stays in the JVM.
    """
    config = config or EngineConfig()
    body, size = F.col("body"), F.length("body")
    whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))
    found = sections.where(F.regexp_like(body, F.lit(r"[^\s\p{Z}]"))).withColumn(
        "spans",
        F.when(size <= config.hard_chars, whole).otherwise(
            capped_spans(packed_spans(t.sentence_spans(body), config), size, config)
        ),
    )
    keep = ["doc_id", "section_no", "section_path", "page_start", "page_end", "line_start", "line_end"]
    parts = found.select(*keep, "char_start", "body", F.posexplode("spans").alias("span_no", "span")).select(
        *keep,
        "span_no",
        (F.col("char_start") + F.col("span.start")).alias("char_start"),
        (F.col("char_start") + F.col("span.end")).alias("char_end"),
        F.substring(body, F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("text"),
    )
    parts = parts.where(F.regexp_like("text", F.lit(r"[^\s\p{Z}]")))
    order = Window.partitionBy("doc_id").orderBy("section_no", "span_no")
    out = parts.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("language", t.detect_language(F.col("text")))
    if hashes:
        out = out.withColumn("chunk_hash", identity.chunk_hash(F.col("section_path"), F.col("text")))
    return out.drop("section_no", "span_no")


def dominant_language(chunks: DataFrame) -> DataFrame:
    """(doc_id, language): the most frequent language of a document's chunks; ties go to English, then to the language
    seen first. Chunks without a language don't count."""
    counted = chunks.where(F.col("language").isNotNull()).groupBy("doc_id", "language").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    best = F.max_by("language", F.struct("n", (F.col("language") == "en").alias("english"), -F.col("first")))
    return counted.groupBy("doc_id").agg(best.alias("language"))
