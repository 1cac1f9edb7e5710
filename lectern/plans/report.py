"""The evaluation as a Markdown text, from small tables that were already aggregated."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

#: Rows of a table that are shown; the rest is said to be left out.
SHOWN = 200


def _cell(value: object) -> str:
    if value is None:
        return "–"
    return f"{value:.3f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(columns: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """A table of any rows; line breaks and bars in cells are made harmless."""
    lines = [" | ".join(columns), " | ".join("---" for _ in columns)]
    lines += [" | ".join(map(_cell, r)) for r in rows]
    return "\n".join(f"| {line} |" for line in lines)


def render(title: str, parts: Mapping[str, DataFrame], notes: Sequence[str] = ()) -> str:
    """The report: every part under its heading, sorted by its columns. Parts must be aggregates; of a longer one the first
    rows are shown and the number of the others is stated."""
    out = [f"# {title}"]
    for heading, df in parts.items():
        rows = df.orderBy(*df.columns).limit(SHOWN + 1).collect()
        out.append(f"## {heading}\n\n{markdown_table(df.columns, rows[:SHOWN])}" if rows else f"## {heading}\n\nNone.")
        if len(rows) > SHOWN:
            out.append(f"{df.count() - SHOWN} more rows are not shown.")
    return "\n\n".join([*out, *(f"* {n}" for n in notes)]) + "\n"
