"""Readers of what earlier runs wrote: coefficient tables, context effects, run metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_coefficients(spark: SparkSession, path: str, contexts: list[str]) -> DataFrame:
    """``gene, mechanism, coef`` of a tab-separated table with a row for every gene and a column for every context, in that order."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    if df.columns[1:] != list(contexts):
        raise ValueError("the table's columns are not the contexts")
    pairs = F.array(*[F.struct(F.lit(c).alias("mechanism"), F.col(f"`{c}`").cast("double").alias("coef")) for c in contexts])
    return df.select(F.col(f"`{df.columns[0]}`").alias("gene"), F.explode(pairs).alias("r")).select("gene", "r.mechanism", "r.coef")


def read_context_effects(spark: SparkSession, path: str, contexts: list[str]) -> list[tuple[str, float, float | None]]:
    """Effects in the order of ``contexts`` from a table ``context, effect[, standard_error]``: unique, complete and not negative."""
    rows = spark.read.csv(path, sep="\t", header=True).limit(len(contexts) + 1).collect()
    by = {r["context"]: r for r in rows}
    if len(by) != len(rows) or set(by) != set(contexts):
        raise ValueError("contexts must be unique and complete")
    out = [(c, float(by[c]["effect"]), float(by[c]["standard_error"]) if "standard_error" in by[c] else None) for c in contexts]
    if any(not e >= 0 for _, e, _ in out):
        raise ValueError("effects must not be negative")
    return out


def read_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """One row for each metadata file that a pattern names, with its path."""
    return spark.read.json(pattern, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))


def name_values(args: list[str]) -> dict[str, str]:
    """``NAME=VALUE`` arguments; the value may hold further equals signs. A missing name, or one that repeats, is an error."""
    out: dict[str, str] = {}
    for a in args:
        name, sep, value = a.partition("=")
        if not sep or not name.strip() or not value or name in out:
            raise ValueError(f"not NAME=VALUE: {a!r}")
        out[name] = value
    return out
