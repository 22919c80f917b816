"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.llm.tables import written


FILE_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of an edge (a, b); root is the smallest id of its component.

    Each round links every node to the smallest node that it or a neighbour knows (large star,
    then small star); rounds end when nothing changes, after about log2 of the longest path.
    Each round is written to shared storage, in files of about ``FILE_EDGES`` edges. Minima are
    combined before the shuffle, so a node with very many edges costs no more than its rows.
    """
    def best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    def size(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    stars = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "edges")
    state = size(stars)
    files = 1 + state[0] // FILE_EDGES
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = best(both).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").coalesce(files), "large-star")
        least = best(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        stars = written(small.union(least.select("a", F.col("m").alias("b"))).distinct().coalesce(files), "small-star")
        now = size(stars)
        if now == state:
            break
        state = now
    roots = stars.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return written(stars.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots), "components")
