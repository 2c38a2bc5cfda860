"""Token sets and term-overlap search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def term_search(corpus: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Rows (id, name, body, and tactics if there: an array of hyphened names) by 4 x name hits + 2 x tactic hits + body hits, those over 0, ties by id."""
    q = tokens(F.lit(query))
    hits = lambda c: F.size(F.array_intersect(tokens(F.coalesce(F.col(c), F.lit(""))), q))
    tactic = F.size(F.array_intersect(tokens(F.replace(F.concat_ws(" ", "tactics"), F.lit("-"), F.lit(" "))), q)) if "tactics" in corpus.columns else F.lit(0)
    scored = corpus.select("id", (4 * hits("name") + 2 * tactic + hits("body")).cast("long").alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
