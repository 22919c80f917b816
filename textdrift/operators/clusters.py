"""Mean silhouettes from the moments of clusters (L13): one aggregate, then one projection.

With squared Euclidean distances a row's mean distance to a cluster needs only the cluster's
size, vector sum and sum of squared norms, so no pair of rows is ever formed. The moments of
all clusters (clusters x dimensions numbers) are one value that every task reads.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.functions.vectors import dot

MAX_CLUSTERS = 4096


def cluster_moments(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """cluster, n, s (sum of vectors) and q (sum of squared norms)."""
    x = F.col(vector)
    return rows.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector(x))).alias("s"),
        F.sum(dot(x, x)).alias("q"))


def silhouettes(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``rows`` with ``silhouette``: (b - a) / max(a, b) of the mean squared distances ``a`` to the
    other rows of its cluster and ``b`` to the nearest other cluster.

    ``vector`` is an array of numbers. Rows without a cluster or vector, or with a NULL component,
    take no part. The only row of a cluster, and equal a and b, give 0; without another cluster it
    is NULL. More than ``MAX_CLUSTERS`` clusters are refused: the moments would not stay small.
    """
    names = rows.columns
    full = rows.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, F.isnull)) \
        .select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(cluster).alias("_c"),
                F.col(vector).cast("array<double>").alias("_x"))
    moments = cluster_moments(full, "_c", "_x")
    all_of_them = moments.agg(F.when(F.count(F.lit(1)) > MAX_CLUSTERS, F.raise_error(F.lit("too many clusters"))).otherwise(
        F.collect_list(F.struct("cluster", "n", "s", "q")))).scalar()
    far = F.transform("_m", lambda m: F.struct(
        m["cluster"].alias("cluster"), m["n"].alias("n"),
        F.greatest(F.lit(0.0), F.col("_xx") + m["q"] / m["n"] - 2 * dot(F.col("_x"), m["s"]) / m["n"]).alias("d")))
    own = F.filter("_far", lambda f: f["cluster"] == F.col("_c"))[0]
    x = full.withColumns({"_m": all_of_them, "_xx": dot(F.col("_x"), F.col("_x"))}).withColumn("_far", far)
    x = x.withColumns({"_n": own["n"], "_a": own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1)), "_b": F.array_min(F.transform(
        F.filter("_far", lambda f: f["cluster"] != F.col("_c")), lambda f: f["d"]))})
    value = (F.when(F.col("_b").isNull(), F.lit(None).cast("double"))
             .when((F.col("_n") == 1) | (F.col("_a") == F.col("_b")), 0.0)
             .otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")))
    return x.select("_row.*", value.alias("silhouette"))


def silhouette_by_cluster(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Rows and mean silhouette of each cluster."""
    return silhouettes(rows, cluster, vector).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("silhouette").alias("silhouette"))
