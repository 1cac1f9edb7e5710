"""Identities of documents, chunks and embedding inputs. The formulas are contracts between tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import normalize


def basename(filename: Column) -> Column:
    """Filename without folders, of either kind of slash."""
    return F.regexp_extract(F.translate(filename, "\\", "/"), r"([^/]*)$", 1)


def stem(filename: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(filename), r"\.[^.]*$", "")


def extension(filename: Column) -> Column:
    """Lower-case extension with its point, or an empty string."""
    return F.lower(F.regexp_extract(basename(filename), r"(\.[^.]*)$", 1))


def default_doc_id(filename: Column) -> Column:
    """Base name without extension in lower case, anything but letters and digits as single hyphens, or ``document``."""
    slug = F.regexp_replace(F.lower(stem(filename)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.trim(slug, F.lit("-")), F.lit("")), F.lit("document"))


def chunk_id(doc_id: Column, version: Column, ordinal: Column) -> Column:
    """Document, version and ordinal in one id."""
    return F.format_string("%s:v%d:%d", doc_id, version, ordinal)


def content_hash(data: Column) -> Column:
    """Hash of raw bytes, or of a text's UTF-8 bytes: decides whether anything changed."""
    return F.sha2(data, 256)


def chunk_hash(path: Column, text: Column) -> Column:
    """Hash of the breadcrumb and the normalised text: the same over edits of white space only."""
    return F.sha2(F.concat(F.array_join(path, " > "), F.lit("\x00"), normalize(text)), 256)


def embed_input(title: Column, path: Column, text: Column) -> Column:
    """What is embedded for a chunk: title and breadcrumb, a blank line, the text as it is."""
    return F.concat(title, F.lit(" > "), F.array_join(path, " > "), F.lit("\n\n"), text)


def collection_name(model: Column, dim: Column) -> Column:
    """Name of the vectors of one model and length, at most 63 characters."""
    slug = F.trim(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "-"), F.lit("-"))
    tail = F.concat(F.lit("__d"), dim.cast("string"))
    return F.concat(F.substring(F.concat(F.lit("chunks__"), slug), F.lit(1), F.lit(63) - F.length(tail)), tail)
