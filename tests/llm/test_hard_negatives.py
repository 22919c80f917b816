import math
import random

import numpy as np
import pytest
from helpers import ordered

from textdrift.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, score double, stripe string, v string"


def mined(rows, o):
    v = []
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % o.shifted == 0 else label
        v.append((i, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i, label, e in {i: (i, lab, e) for i, lab, e in sorted(v, reverse=True) if i % o.every == 0}.values():
        scored = [(-sum(x * y for x, y in zip(e, f)), j, other == label) for j, other, f in v if j != i]
        for s, j, _ in sorted(x for x in scored if x[2])[:o.positives]:
            s = -s
            rest = sorted(x for x in scored if not x[2] and o.least * s <= -100 * x[0] <= o.most * s)
            out += [(i, j, k, n, s, -t) for k, (t, n, _) in enumerate(rest[:o.negatives], 1)]
    return out


def vectors(n, dims, seed, copies=0, scale=1.0):
    r = random.Random(seed)
    one = [r.gauss(0, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = [x + r.gauss(0, 0.01) for x in one] if i < copies else [r.gauss(0, 1) for _ in range(dims)]
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        rows.append((i, r.randrange(3), [scale * x / norm for x in v]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", None) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows", [
    vectors(300, 16, 1, copies=120), vectors(150, 64, 2), vectors(60, 3, 3, scale=5000.0),
    # ties, nulls, infinities, zeros, vectors of other lengths, and fewer rows than asked for
    [(i, i % 2, [0.5, 0.5]) for i in range(30)] + [(None, 1, [1.0, 1.0]), (40, None, [1.0, 1.0]), (41, 1, None),
     (42, 1, [None, 1.0]), (43, 1, [float("nan"), 1.0]), (44, 1, [1.0, float("inf")]), (45, 1, []), (46, 0, [1.0]),
     (47, 0, [0.0, 0.0]), (48, 1, [0.25, 0.5, 0.75]), (49, 0, [0.3, 0.2])],
    [(0, 1, [1.0]), (1, 2, [-1.0])]])
@pytest.mark.parametrize("stripe", [40, 1 << 16])
def test_negatives_match_all_pairs(spark, rows, stripe):
    o = H.Options(every=10)
    got = H.mine(frame(spark, rows), o, stripe=stripe, block=7)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert ordered(got.collect()) == ordered(mined(rows, o))


def test_repeated_rows_are_partners_but_one_anchor(spark):
    rows = vectors(40, 8, 4) * 2
    o = H.Options(every=10, positives=4, negatives=6)
    assert ordered(H.mine(frame(spark, rows), o).collect()) == ordered(mined(rows, o))


def test_empty_table(spark):
    assert H.mine(frame(spark, [])).count() == 0
    assert H.mine(frame(spark, [(1, 1, [1.0])])).count() == 0


def test_index_leaves_out_prefixes_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(500, 64)) / 8)
    x[:, :20] *= 0.1                                    # weak leading dimensions
    q = x[:40] + np.floor(rng.normal(size=(40, 64)) * 5)
    t = np.full(40, 20000.0)
    index = H.Index(x)
    listed = [tile.listed for tile in index.tiles(float((t / np.sqrt((q ** 2).sum(1))).min()))]
    assert listed[0][0] < len(x) and listed[0][-1] == len(x)
    monkeypatch.setattr(H, "DENSE", 0.5)
    found = {(a, b) for who, row, _ in H.threshold_join(index, q, t) for a, b in zip(who.tolist(), row.tolist())}
    assert found == set(zip(*(i.tolist() for i in np.nonzero(q @ x.T >= 20000.0))))


def test_integers_beyond_doubles_are_exact(spark):
    big = [(i, i % 2, [float(2 ** 18) * (i + 1), 1.0 / 256 * i]) for i in range(30)]
    o = H.Options(every=10, shifted=1000)
    assert ordered(H.mine(frame(spark, big), o).collect()) == ordered(mined(big, o))
