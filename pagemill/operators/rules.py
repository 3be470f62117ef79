"""Constraint checks: valid rows, quarantine and violation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rules: name -> test that must hold; NULL counts as held, as in SQL CHECK."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in rules.items()])))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = mark_violations(df, rules)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row with their counts; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violation_counts(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]]) -> DataFrame:
    """Long form (rule, violations): all row rules in one aggregate, unique keys apart."""
    names = list(rules)
    row = df.agg(*[F.count_if(~rules[n]).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    out = row.select(F.expr(f"stack({len(names)}, {pairs}) AS (rule, violations)"))
    for name, keys in unique.items():
        extra = duplicate_keys(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(extra.select(F.lit(name).alias("rule"), "violations"))
    return out
