import random

import numpy as np
from helpers import documents, edge_pairs, near_classes, ordered, prose

from textdrift.llm import near_duplicates as N
from textdrift.llm.components import components


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(out)


def pairs():
    rng = random.Random(5)
    out = edge_pairs() + [(4, "ONE"), (9, "Two Words"), (10, "two words more now")]
    base = prose(3, 220).split()
    out += [(100 + i, edited(base, rng, 1 + i % 6)) for i in range(120)]       # around the threshold
    for g in range(25):
        base = prose(200 + g, rng.randrange(4, 90)).split()
        out += [(1000 + 10 * g + i, edited(base, rng, i % 3)) for i in range(4)]
    chain = prose(900, 100).split()
    for i in range(12):                                    # neighbours are close, ends are not
        out.append((2000 - i, " ".join(chain[3 * i:] + [f"n{j}" for j in range(3 * i)])))
    return out


def test_classes_match_all_pairs(spark):
    rows = N.near_duplicates(documents(spark, pairs())).collect()
    expected = near_classes(pairs())
    assert ordered(r[:3] for r in rows) == ordered(e[:3] for e in expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark, pairs())
    kept = N.without_near_duplicates(docs)
    assert kept.schema == docs.schema
    expected = near_classes(pairs(), size=5)
    some = {c: i for _, n, i, c in expected if n}
    blank = [i for i, n, *_ in expected if not n]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*some.values(), *blank], key=repr)


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, int(j)) for j in range(101, 200)] + [(300, 301), (301, 300), (5, 5)]
    edges = [(int(a), int(b)) if rng.random() < 0.5 else (int(b), int(a)) for a, b in edges]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 200)}, 300: 300, 301: 300}


def test_neighbours_across_the_ends_of_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = prose(1, 60).split()
        some = [(i, " ".join(base + [f"x{i}"])) for i in range(40)]
        rows = N.near_duplicates(documents(spark, some)).collect()
        assert {r.component_id for r in rows} == {0}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def crowd(n, own):
    """Documents that share a passage, each with ``own`` words of its own; some have a twin."""
    passage, rng = prose(77, 80).split(), random.Random(8)
    out = []
    for i in range(n):
        mine = passage + [f"o{i}x{j}" for j in range(own)]
        out.append((i, " ".join(mine)))
        if i % 10 == 0:
            out.append((10_000 + i, " ".join(mine[:rng.choice((-1, -4, -12))])))
    return out


def test_blocks_of_a_crowd_are_bounded_and_find_all(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_NODES", 16)
    sizes, blocks = [], N._blocks

    def measured(*args):
        out = blocks(*args)
        sizes.extend(r["count"] for r in out.groupBy(*N._BLOCK).count().collect())
        return out
    monkeypatch.setattr(N, "_blocks", measured)
    docs = crowd(200, 14)
    rows = N.near_duplicates(documents(spark, docs)).collect()
    assert ordered(r[:3] for r in rows) == ordered(e[:3] for e in near_classes(docs))
    assert sizes and max(sizes) <= 3 * 16


def test_words_that_a_crowd_shares_are_not_listed(spark):
    sets = spark.createDataFrame([(i, [*range(1 << 50, 61 << 50, 1 << 50), *range((100 + 40 * i) << 50, (140 + 40 * i) << 50, 1 << 50)])
                                  for i in range(50)], "id long, grams array<long>")
    assert N.prefixes(sets, N.THRESHOLD).count() == 0


def test_a_crowd_without_any_candidate_is_compared(spark, monkeypatch):
    found = N.candidates

    def none(nodes, least):
        pairs, crowded = found(nodes, least)
        return pairs.limit(0), crowded
    monkeypatch.setattr(N, "candidates", none)
    passage = prose(70, 163).split()
    docs = [(i, " ".join(passage + [f"o{i}x{j}" for j in range(65)])) for i in range(60)]
    for i in range(0, 60, 10):                   # 225 shingles, 200 of them also in the twin
        words = docs[i][1].split()
        docs.append((1000 + i, " ".join(words[:-25] + [f"t{i}x{j}" for j in range(25)])))
    twins = [(i, 1000 + i) for i in range(0, 60, 10)]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, docs)).collect()}
    expected = {i: c for i, _, c, _ in near_classes(docs)}
    assert all(expected[b] == a for a, b in twins)
    assert got == expected
