"""Decaying taint over a reference graph: at most a few hops, each a join and a maximum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scoring import rounded
from veilspark.sources.sinks import stored


def taint(edges: DataFrame, seeds: DataFrame, decay: float = 0.85, hops: int = 3, floor: float = 0.05, named: bool = True) -> DataFrame:
    """node, score, via, hops: the best score with which any seed (node, score) reaches a node over edges (src, dst), in the
    fewest hops, from the least of the seeds that give it. Without `named` there is no via, and scores alone are carried along.

    Edges may repeat. Frontiers are written once, so that none is planned anew inside the next, and hold only what improved on
    its node; so a node's last one is its best. New scores meet those held in one aggregate.
    """
    via = ["via"] if named else []

    def least(rows: DataFrame) -> DataFrame:
        if not named:
            return rows.groupBy("node").agg(F.max("score").alias("score"))
        return rows.groupBy("node", "score").agg(F.min("via").alias("via")).groupBy("node").agg(F.max_by(F.struct("score", "via"), "score").alias("b")).select("node", "b.*")

    first = seeds.withColumn("via", F.col("node")) if named else seeds
    frontiers = [stored(least(first.select("node", "score", *via)).withColumn("hops", F.lit(0)), "frontier")]
    for hop in range(1, hops + 1):
        step = frontiers[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), rounded(F.col("score") * decay, 4).alias("score"), *via)
        step = step.filter(F.col("score") >= floor)
        step = least(step) if named else step
        held = reduce(DataFrame.unionAll, frontiers).select("node", F.col("score").alias("held"))
        every = step.unionByName(held, allowMissingColumns=True).groupBy("node").agg(*[F.max(c).alias(c) for c in ("score", *via, "held")])
        better = every.filter("score is not null and (held is null or score > held)").drop("held")
        frontiers.append(stored(better.withColumn("hops", F.lit(hop)), "frontier"))
    best = [F.max("score").alias("score"), *[F.max_by(c, "hops").alias(c) for c in via], F.max("hops").alias("hops")]
    return reduce(DataFrame.unionAll, frontiers).groupBy("node").agg(*best)
