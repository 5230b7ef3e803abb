"""Label search and table ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import parse_coordinate
from ..functions.numeric import col
from .runtime import spread


def _tier(q: Column, text: Column) -> Column:
    """100 label start, 80 word start, 40 letters in order, else 0."""
    t = F.lower(text)
    # q's characters in order with anything between, quoted for the pattern.
    pattern = F.concat(
        F.lit("(?s)"),
        F.array_join(F.transform(F.split(q, ""), lambda ch: F.concat(F.lit(r"\Q"), ch, F.lit(r"\E"))), ".*"),
    )
    words = F.exists(F.split(t, r"\s+"), lambda w: F.startswith(w, q))
    return (
        F.when(F.startswith(t, q), 100.0).when(words, 80.0).when(F.call_function("rlike", t, pattern), 40.0).otherwise(0.0)
    )


def match_score(query, label, keywords=None) -> Column:
    q = F.lower(F.trim(col(query)))
    score = F.coalesce(_tier(q, col(label)), F.lit(0.0))
    if keywords is not None:
        score = F.greatest(score, F.coalesce(_tier(q, col(keywords)), F.lit(0.0)) * 0.5)
    return F.when(q == "", 0.0).otherwise(score)


def search_labels(items: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """Matching items per query and section, best first; an empty query lists each section.
    ``top`` keeps so many.

    Items: section, ordinal, label, keywords. Queries: query_id, query. Every item is
    scored against every query, so the queries should be the few; ranks are cut on
    the map side. A query that reads as a coordinate gives one "Go to" row.
    """
    q = queries.withColumn("_q", F.lower(F.trim("query"))).withColumn("_p", parse_coordinate(F.trim("query")))
    text = q.where(F.col("_p").isNull()).select("query_id", "_q")
    # An item becomes a row per query, and each task sorts its rows to cut ranks: small shares of the items.
    scored = spread(items, "section", "ordinal").join(text, F.lit(True)).withColumn("score", match_score("_q", "label", "keywords"))
    scored = scored.where((F.col("score") > 0) | (F.col("_q") == ""))
    w = Window.partitionBy("query_id", "section").orderBy(F.desc("score"), "ordinal")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.select("query_id", "section", "rank", "label", "score", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    goto = q.where(F.col("_p").isNotNull()).select(
        "query_id", F.lit("Go to").alias("section"), F.lit(1).alias("rank"), F.trim("query").alias("label"), F.lit(0.0).alias("score"),
        F.col("_p.lat").alias("lat"), F.col("_p.lng").alias("lng"),
    )
    return ranked.unionByName(goto)


def sort_table(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Ordered rows; missing values come last both ways, text ignores case."""
    c = F.col(column)
    key = F.lower(c) if dict(df.dtypes)[column] == "string" else c
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last())
