"""Splits that keep related records together: components first, then largest-differencing balance.

Components are put into many equal bins by repeatedly combining extreme weights: each round orders
the units by weight and joins the heaviest with the lightest, the second heaviest with the second
lightest, and so on, which halves the number of units and evens them out. When at most ``bins``
units are left, whole bins are dealt to the splits, heaviest first, each to the split that lacks
most of its target. The rounds are Spark jobs; only the last ``bins`` weights reach the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.index import dense_index
from ..session import Scratch
from .components import connected_components

#: Genes are numbered from here in the graph of variants and genes, so that a family's lowest vertex is a variant.
GENES = 1 << 62
#: Most bins that are dealt on the driver.
BINS = 100
#: Most units that one task ranks.
ONE_TASK = 100_000


def families(triples: DataFrame, variant: str = "variant_idx", gene: str = "gene_idx") -> DataFrame:
    """``family_idx, kind ('variant' or 'gene'), idx`` of all variants and genes that rows tie together.

    Every row with a variant and a gene (neither null nor negative) ties the two, whatever its other
    columns hold. A family is named by its lowest variant. Identifiers must be below 2^62.
    """
    v, g = F.col(variant).cast("long"), F.col(gene).cast("long")
    ties = triples.where((v >= 0) & (g >= 0)).select(v.alias("a"), (g + F.lit(GENES)).alias("b"))
    c = connected_components(ties, "a", "b")
    is_gene = F.col("id") >= GENES
    return c.select(F.col("group_idx").alias("family_idx"), F.when(is_gene, "gene").otherwise("variant").alias("kind"), F.when(is_gene, F.col("id") - GENES).otherwise(F.col("id")).alias("idx"))


def with_untied(fam: DataFrame, triples: DataFrame, variant: str = "variant_idx", gene: str = "gene_idx") -> DataFrame:
    """``fam`` and, as families of one, the variants and genes that no row ties to anything.

    A variant alone is named by itself, a gene alone by its vertex, from 2^62 on.
    """
    v, g = F.col(variant).cast("long"), F.col(gene).cast("long")
    has_v, has_g = F.coalesce(v >= 0, F.lit(False)), F.coalesce(g >= 0, F.lit(False))
    lone = triples.where(has_v != has_g).select(F.when(has_v, v).otherwise(g + F.lit(GENES)).alias("family_idx"), F.when(has_v, "variant").otherwise("gene").alias("kind"), F.when(has_v, v).otherwise(g).alias("idx"))
    return fam.unionByName(lone.distinct().join(fam, ["kind", "idx"], "left_anti"))


def balanced_bins(scratch: Scratch, weights: DataFrame, bins: int = BINS, one_task: int = ONE_TASK) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``unit -> bin`` for a table ``unit, weight``, and the bins' weights (at most ``bins`` of them).

    Rounds of at most ``one_task`` units are ranked in one task, larger ones over range partitions.
    """
    # a bin is named by the smallest unit in it; `hops` lead from a round's units to the next round's
    level = scratch.stage(weights.select("unit", "weight"))
    n, hops = level.count(), []
    while n > bins:
        order = [F.col("weight").desc(), F.col("unit").asc()]
        if n > one_task:
            ranked = dense_index(level, order, "n", scratch)
        else:
            ranked = level.withColumn("n", F.row_number().over(W.orderBy(*order)).cast("long") - 1)
        # of an odd number the heaviest stays alone: ranks 1..n-1 are paired from both ends, rank 0 with itself
        odd = n % 2
        paired = ranked.withColumn("mate", F.when(F.col("n") < odd, F.lit(-1)).otherwise(F.least(F.col("n"), F.lit(n - 1 + odd) - F.col("n"))))
        two = W.partitionBy("mate")  # at most two rows
        hop = scratch.stage(paired.select("unit", F.min("unit").over(two).alias("bin"), F.sum("weight").over(two).alias("weight")))
        hops.append(hop)
        level = hop.where("unit = bin").select("unit", "weight")
        n = (n + 1) // 2
    last = [(r.unit, r.weight) for r in level.collect()]  # at most `bins` rows
    where = level.select("unit", F.col("unit").alias("bin"))
    for hop in reversed(hops):
        where = hop.select("unit", F.col("bin").alias("via")).join(where.withColumnRenamed("unit", "via"), "via").select("unit", "bin")
    return scratch.stage(where), last


def deal(bins: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits: heaviest first, each to the split that lacks most of its target."""
    total = sum(w for _, w in bins)
    norm = sum(shares.values())
    lack = {s: total * x / norm for s, x in shares.items()}
    out = {}
    for unit, w in sorted(bins, key=lambda b: (-b[1], b[0])):
        split = max(lack, key=lambda s: lack[s])
        out[unit] = split
        lack[split] -= w
    return out


def assign_splits(members: DataFrame, group: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """``members`` with the columns ``split`` and ``bin`` (in place of ones that are there), the same for all rows of a group.

    Null groups have no relatives and give no row; repeated rows weigh what they count; an empty
    input gives an empty result. The split sizes follow ``shares`` as nearly as whole bins allow.
    """
    spark = members.sparkSession
    scratch = Scratch(spark, "splits")
    g = F.col(group)
    weights = members.where(g.isNotNull()).groupBy(g.alias("unit")).agg(F.count(F.lit(1)).alias("weight"))
    where, last = balanced_bins(scratch, weights, bins)
    scratch.close(where)
    dealt = deal(last, shares)
    if not dealt:
        return members.where(g.isNotNull()).withColumn("split", F.lit(None).cast("string")).withColumn("bin", F.lit(None).cast("long"))
    table = spark.createDataFrame(list(dealt.items()), "bin long, split string")
    unit, split, name = (f"_{uuid.uuid4().hex}" for _ in "abc")  # no name of the members' columns
    where = where.join(F.broadcast(table), "bin").select(F.col("unit").alias(unit), F.col("split").alias(split), F.col("bin").alias(name))
    return members.join(where, g == F.col(unit)).withColumn("split", F.col(split)).withColumn("bin", F.col(name)).drop(unit, split, name)


def broken_families(fam: DataFrame, folds: DataFrame, variant: str = "variant_idx", stored: tuple[str, ...] = ("cv_groups", "cv_score_groups")) -> DataFrame:
    """``family_idx, variant_idx`` of the families whose rows in ``folds`` hold more than one fold.

    Nulls and -1 are no folds; all ``stored`` columns are taken together; variants without a stored
    row do not matter.
    """
    v = fam.where("kind = 'variant'").select("family_idx", F.col("idx").alias("variant_idx"))
    f = folds.select(F.col(variant).cast("long").alias("variant_idx"), F.explode(F.array(*[F.col(c).cast("int") for c in stored])).alias("fold"))
    f = f.where("fold is not null and fold != -1").groupBy("variant_idx").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    bad = v.join(f, "variant_idx").groupBy("family_idx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("family_idx")
    return v.join(bad, "family_idx", "left_semi")
