"""Effective-dated reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.versions import valid_at
from tidewell.streaming.folder import shared_folder


def reachable(edges: DataFrame, start: DataFrame, at: Column | None = None, least: float = 0.5) -> DataFrame:
    """(origin, node, hops, certainty, admissible): each node by the path that a search in breadth finds first.

    edges: src, dst, certainty (1 where missing), and with `at` valid_from and valid_to, of which the end is open. Of
    paths with the fewest edges the first in order of its nodes counts, not the most certain one. Every hop extends the
    frontier alone and is cut off by a checkpoint, so a hop's plan names earlier ones as tables only; the search ends
    when nothing new is found.
    """
    shared_folder(edges.sparkSession)
    live = edges.filter(valid_at(at, F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.col("valid_to"))) if at is not None else edges
    live = live.select("src", "dst", F.coalesce("certainty", F.lit(1.0)).alias("_c"))
    frontier = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hops"), F.lit(1.0).alias("certainty"), F.array("node").alias("path")).distinct().checkpoint()
    found, hop = frontier, 0
    while not frontier.isEmpty():
        hop += 1
        ahead = frontier.withColumnRenamed("node", "src").join(live, "src")
        path = F.struct(F.concat("path", F.array("dst")).alias("path"), (F.col("certainty") * F.col("_c")).alias("certainty"))
        ahead = ahead.groupBy("origin", F.col("dst").alias("node")).agg(F.min(path).alias("p")).select("origin", "node", F.lit(hop).alias("hops"), "p.certainty", "p.path")
        frontier = ahead.join(found.select("origin", "node"), ["origin", "node"], "left_anti").checkpoint()
        found = found.unionByName(frontier)
    return found.select("origin", "node", "hops", "certainty", (F.col("certainty") >= least).alias("admissible"))
