import collections
import random
import re

import numpy as np
import pytest
from helpers import documents, edge_pairs, ordered, prose

from textdrift.llm import collocations, skew


def mined(rows, least, top, contained=50):
    """(lang, rank, phrase, a, l, r, n, score) of all phrases, by counting everything."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        some = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        found = []
        for k, a in some.items():
            if len(k) == 2 and any(len(x) == 3 and k in (x[:2], x[1:]) and 100 * v >= contained * a
                                   for x, v in some.items()):
                continue
            score, i = min((1000000 * a * a // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), c[k[:i]], c[k[i:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def texts():
    r = random.Random(5)
    words = ["Alpha", "beta", "gamma", "the", "of", "ñandú", "x\x1cy", "e"]
    return [(i, " ".join(r.choice(words) + r.choice(["", "", "", ",", ". ", "\n", "\t"]) for _ in range(200)))
            for i in range(30)] + [(50 + i, "new york city. los angeles, los angeles") for i in range(12)]


@pytest.mark.parametrize("least,top,frontier", [(10, 2000, 4), (3, 7, 1), (5, 3, 1), (2, 40, 1)])
def test_phrases_match_counting_everything(spark, least, top, frontier):
    pairs = texts() + edge_pairs() + [(90, prose(4, 3000, words=30))]
    docs = documents(spark, pairs)
    rows = collocations.mine(docs, least, top, frontier=frontier, widen=2)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert ordered(rows.collect()) == ordered(mined([(d.lang, d.text) for d in docs.collect()], least, top))


def test_without_phrases(spark):
    assert collocations.mine(documents(spark, [])).count() == 0
    assert collocations.mine(documents(spark, [(1, None), (2, " \t"), (3, "a b. c")])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 9_100_000_000_000)], "a long, l long, r long")
    a, left, right = rows.first()
    got = rows.selectExpr(collocations._exact("1000000 * a * a / l * r")).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_bloom_filter_misses_no_member(spark):
    members = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    found = skew.Bloom.of(spark.createDataFrame([(int(x),) for x in members], "hash long"), 5000)
    assert found.has(members).all()
    assert found.has(np.random.default_rng(2).integers(-2**63, 2**63 - 1, 5000)).mean() < 0.05
    assert not skew.Bloom.of(spark.createDataFrame([], "hash long"), 0).has(members).any()


def test_attach_with_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("none", 2), (None, 3)], "k string, i int")
    table = spark.createDataFrame([("hot", 100), ("cold", 1)], "k string, n long")
    out = skew.attach(rows, table, ["k"], table["n"] >= 50).collect()
    assert ordered(out) == ordered([("hot", i, 100) for i in range(50)] + [("cold", 1, 1)])
