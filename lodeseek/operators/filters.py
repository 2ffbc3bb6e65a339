"""What a viewer of graphs, profiles and traces narrows down. [E10, I8]

All are filters of rows; nothing is shuffled. Texts are trimmed and compared without case; an empty text keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY, FIRST = "all", 8


def wanted(text: str) -> str:
    return text.strip().lower()


def holding(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON holds the text."""
    return rows.where(F.contains(F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))), F.lit(wanted(text)))) if wanted(text) else rows


def of_relation(rows: DataFrame, relation: str = ANY) -> DataFrame:
    """Rows of one relation (edges, relation counts)."""
    return rows if relation == ANY else rows.where(F.col("relation") == relation)


def inventory(profiles: DataFrame, text: str = "", column: str = "references") -> DataFrame:
    """document_id, kind, refs of profiles whose kind or any reference holds the text."""
    rows = profiles.select("document_id", F.explode(column).alias("kind", "refs"))
    has = lambda c: F.contains(F.lower(c), F.lit(wanted(text)))
    return rows.where(has(F.col("kind")) | F.exists("refs", has)) if wanted(text) else rows


def relations_of(evidence: DataFrame) -> Column:
    """The graph relations of evidence rows; null for others."""
    return F.split(F.try_element_at("metadata", F.lit("relations")), ",")


def reached_by(evidence: DataFrame, relation: str = ANY) -> DataFrame:
    """Evidence that graph search reached; by one relation, if it is named."""
    found = evidence.where(F.coalesce(F.try_element_at("metadata", F.lit("relations")), F.lit("")) != "")
    return found if relation == ANY else found.where(F.array_contains(relations_of(found), relation))


def on_path(rows: DataFrame, path: str, column: str = "path") -> DataFrame:
    """Steps or evidence whose path starts with this one."""
    return rows.where(F.startswith(F.col(column), F.lit(path)))


def first_rows(rows: DataFrame, *order: str, n: int = FIRST) -> DataFrame:
    """The first rows in an order: at most n from every task."""
    return rows.orderBy(*order).limit(n)
