"""Joins without hot keys, and bounded Bloom filters, both from counts that Spark has aggregated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with this share of all counted things, or more, is heavy: there are at most 1 / share.
HEAVY_SHARE = 1e-4


def attach(rows: DataFrame, table: DataFrame, on: list[str], heavy: Column) -> DataFrame:
    """``rows`` inner-joined with ``table`` (unique in ``on``): its ``heavy`` rows, whose number must
    have a proven bound, are broadcast; only the others are looked up by shuffle, where no key is
    hot, since rows that are already served are dealt by a salt."""
    values = [c for c in table.columns if c not in on]
    table = table.withColumn("_heavy", heavy)
    hot = table.where("_heavy").select(*on, F.struct(*values).alias("_hot"))
    cold = table.where("NOT _heavy").select(*on, F.struct(*values).alias("_cold"), F.lit(0).alias("_salt"))
    served = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        (F.pmod(F.monotonically_increasing_id(), F.lit(4096)) + 1).cast("int")))
    found = served.join(cold, [*on, "_salt"], "left").withColumn("_hot", F.coalesce("_hot", "_cold"))
    return found.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in values])


class Bloom:
    """A set of 64-bit hashes that may also hold others: at most 2^25 bits (4 MB), however many
    members, so that it can be broadcast. Members are never missed."""

    LEAST, MOST = 16, 25

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @classmethod
    def of(cls, hashes: DataFrame, members: int) -> Bloom:
        """The filter of a column ``hash``, whose bits Spark combines."""
        bits = 1 << int(np.clip(np.ceil(np.log2(max(members, 1) * 16)), cls.LEAST, cls.MOST))
        places = hashes.select(F.explode(F.array(
            F.col("hash").bitwiseAND(bits - 1),
            F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1))).alias("p"))
        rows = places.groupBy(F.shiftright("p", 6).alias("cell")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("mask")).toArrow()
        cells = np.zeros(bits >> 6, np.uint64)
        cells[rows["cell"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        return cls(cells)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """True for every member (and for few others)."""
        hashes = hashes.view(np.uint64)
        bits = np.uint64(len(self.cells) * 64 - 1)
        out = np.ones(len(hashes), dtype=bool)
        for place in (hashes & bits, (hashes >> np.uint64(32)) & bits):
            out &= (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out
