"""Rendering of small results, prompts and id remaps."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import POSITIVE_LABELS, seeded_hash
from .selection import seeded_rank

#: Rows that a rendered report holds; reports are aggregates, a larger table is refused.
MOST_ROWS = 1000


def _cell(value: object, percent: bool) -> str:
    if value is None:
        return "n/a"
    return f"{100 * value:.1f} %" if percent else f"{value:g}" if isinstance(value, float) else str(value)


def report_rows(df: DataFrame, order: list[str]) -> list:
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report holds {MOST_ROWS} rows at most")
    return rows


def markdown_table(df: DataFrame, order: list[str], percent: frozenset[str] = frozenset()) -> str:
    """A table of a small result; nulls are ``n/a``, bars in cells are escaped."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for r in report_rows(df, order):
        lines.append("| " + " | ".join(_cell(r[c], c in percent).replace("|", "\\|") for c in df.columns) + " |")
    return "\n".join(lines) + "\n"


def html_table(df: DataFrame, order: list[str], title: str) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(r[c], False))}</td>" for c in df.columns) + "</tr>" for r in report_rows(df, order))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>\n"


def svg_curve(df: DataFrame, x: str, y: str, title: str, width: int = 480, height: int = 240) -> str:
    """A small result as a line over evenly spaced points, values from 0 to 1, with its numbers written at them."""
    rows = report_rows(df, [x])
    at = [(40 + i * (width - 80) / max(1, len(rows) - 1), height - 30 - (height - 70) * float(r[y] or 0)) for i, r in enumerate(rows)]
    marks = "".join(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3"/><text x="{a:.1f}" y="{b - 8:.1f}" text-anchor="middle">{_cell(r[y], True)}</text><text x="{a:.1f}" y="{height - 10}" text-anchor="middle">{html.escape(str(r[x]))}</text>' for (a, b), r in zip(at, rows, strict=True))
    line = " ".join(f"{a:.1f},{b:.1f}" for a, b in at)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11"><text x="10" y="16">{html.escape(title)}</text><polyline points="{line}" fill="none" stroke="black"/>{marks}</svg>\n'


def markdown_report(title: str, sections: list[tuple[str, str, DataFrame | None, list[str], frozenset[str]]]) -> str:
    """A report of sections (heading, text, table or none, its order, its shares)."""
    parts = [f"# {title}\n"]
    for heading, text, table, order, shares in sections:
        parts.append(f"## {heading}\n\n{text}\n" + ("" if table is None else "\n" + markdown_table(table, order, shares)))
    return "\n".join(parts)


def template(name: str, templates: dict[str, str], marker: str = "{{BLOCK}}") -> str:
    """One of the named templates and no other; it must hold its marker once."""
    if name not in templates:
        raise ValueError(f"unknown template {name!r}; there are {', '.join(sorted(templates))}")
    if templates[name].count(marker) != 1:
        raise ValueError("the template must hold its marker once")
    return templates[name]


def few_shot(blocks: DataFrame, key: str = "example_id") -> DataFrame:
    """The first block by id of each label, each from another dialogue, then the first without edges; four tiny queries."""
    taken, out = [], None
    for category in (*POSITIVE_LABELS, "NONE"):
        one = blocks.where((F.col("category") == category) & ~F.col("dialogue_id").isin(*taken, "")).orderBy(key).limit(1)
        row = one.head()
        if row is not None:
            taken.append(row["dialogue_id"])
            own = blocks.where(F.col(key) == row[key])
            out = own if out is None else out.unionByName(own)
    return blocks.where("false") if out is None else out


def dev_selection(updates: DataFrame, blocks: DataFrame, seed: str, none_total: int = 6, per_label: int = 8) -> DataFrame:
    """One NONE block of each dialogue, filled up to ``none_total``; then ``per_label`` blocks of each label, no update twice."""
    none = seeded_rank(blocks.where("category = 'NONE'"), seed, "example_id", ["dialogue_id"], "own")
    first = F.when(F.col("own") == 1, 0).otherwise(1)
    ranked = none.orderBy(first, seeded_hash(seed, F.col("example_id"))).limit(none_total).drop("own")
    out = ranked
    for label in POSITIVE_LABELS:
        rest = blocks.where(F.col("category") == label).join(out.select("update_id"), "update_id", "left_anti")
        one = rest.groupBy("update_id").agg(F.min_by(F.struct(*blocks.columns), seeded_hash(seed, F.col("example_id"))).alias("b")).select("b.*")
        out = out.unionByName(one.orderBy(seeded_hash(seed, F.col("example_id"))).limit(per_label))
    return out.join(updates.select("update_id"), "update_id", "left_semi")


def render_prompts(blocks: DataFrame, template: str, marker: str = "{{BLOCK}}", column: str = "block") -> DataFrame:
    """``blocks`` with ``prompt``: the template with its one marker replaced by the block as indented JSON."""
    if template.count(marker) != 1:
        raise ValueError("the template must hold its marker once")

    @F.pandas_udf(StringType())
    def render(compact: pd.Series) -> pd.Series:
        return compact.map(lambda t: None if t is None else template.replace(marker, json.dumps(json.loads(t), indent=2, ensure_ascii=False)))

    return blocks.withColumn("prompt", render(F.to_json(column)))


def remap_graph(rows: DataFrame, relations_col: str, names_col: str = "names") -> DataFrame:
    """The edges (structs with source, target and type) of remapped texts by the same map; an end that the text doesn't name is an error."""
    new = lambda x: F.coalesce(F.element_at(names_col, x), F.raise_error(F.concat(F.lit("no new id for "), x)).cast("string"))
    edge = lambda r: F.struct(new(r["source"]).alias("source"), new(r["target"]).alias("target"), r["type"].alias("type"))
    return rows.withColumn(relations_col, F.transform(relations_col, edge))


def remap_units(rows: DataFrame, text_col: str, start: int = 1) -> DataFrame:
    """Unit ids ``U1``, ``U2``, ... numbered anew from ``start`` in the order in which each text names them, with the map used."""

    def remap(text: str | None) -> tuple[str | None, dict[str, str]]:
        names: dict[str, str] = {}
        out = None if text is None else re.sub(r"\bU[1-9]\d*\b", lambda m: names.setdefault(m[0], f"U{len(names) + start}"), text)
        return out, names

    from pyspark.sql.types import MapType, StructField, StructType

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("names", MapType(StringType(), StringType()))]))
    def renamed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([remap(t) for t in texts], columns=["text", "names"])

    return rows.withColumn("_r", renamed(text_col)).withColumns({text_col: F.col("_r.text"), "names": F.col("_r.names")}).drop("_r")
