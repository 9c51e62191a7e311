"""Runs that share their first steps: the tree of all runs of a unit, and where two arms part.

A node of the tree is a step with all that went before it. It is named by its place
and a hash of the steps up to it: the exclusive-or of the hashes of (place, step),
which a running window makes as it goes along, so that no list of steps is built. Two
hashes of 64 bits each name a node.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_node(steps: DataFrame, run: list[str], order: str, step: str) -> DataFrame:
    """steps with `place` in the run, from 1, and `node`. Steps of equal order are taken in the order of their text; a null step is a step of its own kind."""
    in_run = W.partitionBy(*run).orderBy(order, step)
    placed = steps.withColumn("place", F.row_number().over(in_run))
    so_far = W.partitionBy(*run).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)

    def prefix(salt: int) -> Column:
        return F.bit_xor(F.xxhash64(F.lit(salt), F.col("place"), F.col(step).isNull(), F.coalesce(F.col(step).cast("string"), F.lit("")))).over(so_far)

    return placed.withColumn("node", F.struct(prefix(1).alias("h1"), prefix(2).alias("h2")))


def tree(nodes: DataFrame, unit: list[str]) -> DataFrame:
    """(unit..., steps, nodes, shared): recorded steps, steps counted once where runs share them, and nodes of more than one run."""
    each = nodes.groupBy(*unit, "place", "node").agg(F.count("*").alias("runs"))
    return each.groupBy(*unit).agg(F.sum("runs").alias("steps"), F.count("*").alias("nodes"), F.count_if(F.col("runs") > 1).alias("shared"))


def partings(nodes: DataFrame, unit: list[str], arm: str, arms: list[str]) -> DataFrame:
    """(unit..., a, b, shared): for each two of the arms that a unit has, how many first steps they share. Nodes are grouped once, whatever the number of arms."""
    has = [F.bool_or(F.col(arm) == x).alias(f"_{i}") for i, x in enumerate(arms)]
    each = nodes.groupBy(*unit, "place", "node").agg(*has)
    pairs = list(combinations(range(len(arms)), 2))
    both = [F.max(F.when(F.col(f"_{i}") & F.col(f"_{j}"), F.col("place"))).alias(f"_p{i}_{j}") for i, j in pairs]
    there = [F.bool_or(f"_{i}").alias(f"_any{i}") for i in range(len(arms))]
    found = each.groupBy(*unit).agg(*both, *there)
    rows = F.array(*[F.when(F.col(f"_any{i}") & F.col(f"_any{j}"), F.struct(F.lit(arms[i]).alias("a"), F.lit(arms[j]).alias("b"), F.coalesce(f"_p{i}_{j}", F.lit(0)).alias("shared"))) for i, j in pairs])
    return found.select(*unit, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(*unit, "r.a", "r.b", "r.shared")
