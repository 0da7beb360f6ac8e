"""Ordering, limits and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.revisions import best
from skylattice.plans.store import sized, stored


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order; planned as a top-k of each partition first."""
    return df.orderBy(*order).limit(n)


def compare_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, only the first, only the second table, and both over union (1 if the union is empty)."""
    one = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    two = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = one.join(two, keys, "full_outer")
    out = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count("*").alias("_all"))
    return out.withColumn("overlap", F.when(F.col("_all") == 0, 1.0).otherwise(F.col("both") / F.col("_all"))).drop("_all")


def best_label(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Name of the largest score (ties: the last name in the alphabet) and its relative lead over the next."""
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(s.alias("score"), F.lit(n).alias("name")) for n, s in scores.items()])))
    first, second = F.get(ranked, 0), F.get(ranked, 1)
    return first["name"], (first["score"] - second["score"]) / F.greatest(first["score"], F.lit(1e-12))


def merge_series(parts: list[DataFrame], source: str, axes: list[str], keys: list[str], revision: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Daily tables on top of each other, and the refused sources: those whose axes differ from the first source's.

    Rows of refused sources are left out. The refused are written and counted first: all rows of a source share a key, so
    the tables are not dealt by it unless there are very many. With ``revision`` (descending sort columns), the best row for each of ``keys`` stays.
    """
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    marks = whole.groupBy(source).agg(*[F.sort_array(F.collect_set(a)).alias(a) for a in axes])
    first = marks.orderBy(source).limit(1).select(*[F.col(a).alias(f"_{a}") for a in axes])
    odd = marks.crossJoin(F.broadcast(first)).where(" OR ".join(f"{a} <> _{a}" for a in axes)).select(source)
    odd = stored(odd, "refused")
    whole = whole.join(sized(odd, rows=odd.count()), source, "left_anti")
    return (best(whole, keys, revision) if revision else whole), odd
