"""Markdown report of an experiment: tables of a few rows per configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def _cell(v: object) -> str:
    return "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)


def markdown_table(table: DataFrame, key: str, order: Sequence[str] = (), max_rows: int = 1000) -> str:
    """The table as Markdown, the configurations of `order` first, in that order. It is meant for aggregates: more than max_rows rows are an error."""
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("a report shows aggregates; aggregate first")
    place = {name: i for i, name in enumerate(order)}
    rows.sort(key=lambda r: (place.get(r[key], len(place)), str(r[key])))
    head = table.columns
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r[c]) for c in head) + " |" for r in rows])


def render_report(sections: list[tuple[str, DataFrame, str]], title: str = "Experiment report", order: Sequence[str] = ()) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{markdown_table(t, key, order)}" for name, t, key in sections) + "\n"
