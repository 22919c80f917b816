import collections
import math
import random
import zlib

import numpy as np
import pytest
from helpers import documents, edge_pairs, prose, spaced
from pyspark.sql import types as T

from textdrift.llm import boosting, language, language_model, pitman_yor, quality

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("text", T.StringType())])


def remainder(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


# quality classifier

def quality_pairs():
    out = edge_pairs()
    for i in range(400):
        words = prose(i, 60).split()
        out.append((100 + i, " ".join(words) if i % 3 else " ".join(w for w in words[:6] for _ in range(10))))
    return out


def labels(spark, pairs):
    rows = [(i, int(i % 3 != 1), "x") for i, _ in pairs if i and i >= 100] + [(100, None, None), (None, 1, None)]
    return spark.createDataFrame(rows, LABELS)


def test_quality_learns_and_scores_every_row(spark):
    docs = documents(spark, quality_pairs())
    forest = quality.train(docs, labels(spark, quality_pairs()))
    rows = quality.score(docs, forest).collect()
    assert len(rows) == len(quality_pairs())
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id and r.doc_id >= 100]
    assert sum(r.predicted == (r.doc_id % 3 != 1) for r in held) >= 0.97 * len(held)
    kept = quality.score(docs, forest, keep_rows=True)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in rows)


def test_quality_without_labels_or_rows(spark):
    docs, none = documents(spark, quality_pairs()), spark.createDataFrame([], LABELS)
    assert quality.train(docs, none) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(documents(spark, []), None).count() == 0


def test_statistics_do_not_depend_on_the_batch():
    import pyarrow as pa
    texts = [t for _, t in quality_pairs()]
    together = quality._batch_statistics(pa.array(texts, pa.string()))
    alone = np.concatenate([quality._batch_statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    forest = boosting.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    slow = [0.0] * 50                                     # flattened arrays, node by node
    for t in range(len(forest.value)):
        for i in range(50):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + (2 if x[2000 + i, forest.feature[t, node]] > forest.threshold[t, node] else 1)
            slow[i] += forest.value[t, node - 2 ** forest.depth + 1]
    assert np.allclose(forest.score(x[2000:2050]), 1 / (1 + np.exp(-np.array(slow))))


# language identification

SYLLABLES = {"en": "th the ing tion wh er ly and of sh ea", "de": "sch der ung keit ß ü ver ö ein ach pf"}


def language_rows():
    rng, out = random.Random(2), []
    for i in range(260):
        lang = ("en", "de")[i % 2]
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 90))]
        out.append((500 + i, " ".join(words), None if i % 11 == 0 else lang))
    return out


def test_language_of_every_row(spark):
    rows = [(i, t, "zz" if i == 1 else None) for i, t in edge_pairs() + [(20, "12 !! 34"), (21, "٣٤ — €")]] + language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (1, 2, 3, 20, 21)] == ["und"] * 5
    assert set(by_id.values()) == {"und", "en", "de"}
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 500]
    assert sum(r.lang_pred == ("en", "de")[r.doc_id % 2] for r in held) >= 0.97 * len(held)


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(docs).collect()} == {("und", 0.0), ("und", 1.0)}
    assert language.identify(docs.limit(0)).count() == 0


def test_tables_give_the_convolution():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (6, language.WIDTH + 3)).astype(np.uint8)
    rows[:, language.WIDTH:] = 0
    net = language.train(np.repeat(rows, 20, 0), np.tile([0, 1], 60), ["a", "b"], steps=5)
    e = net.embedding[net.classes[rows]]
    pooled = []
    for w, f, bias in zip(language.WIDTHS, net.filters, net.biases):
        r = np.stack([sum(e[:, p + j] @ f[j] for j in range(w)) for p in range(language.WIDTH)], axis=1)
        pooled.append(np.maximum(r.max(axis=1) + bias, 0))
    logits = np.concatenate(pooled, axis=1) @ net.out + net.out_bias
    expected = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(rows, net.tables()), expected, atol=1e-4)


# language model

def test_base_scores_and_counts(spark):
    pairs = edge_pairs() + [(100 + i, prose(i, 40, 90)) for i in range(80)] + [(i, "The END\tof it") for i in range(300, 320)]
    rows = language_model.score_corpus(documents(spark, pairs)).collect()
    held = [remainder(i, 10) == 0 for i, _ in pairs]
    tokens = [spaced(t, lower=True) + [None] for _, t in pairs]
    count = collections.Counter(w for h, ws in zip(held, tokens) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    expected = sorted(((i, h, len(ws), sum(count[w] > 0 for w in ws), n,
                        round(sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in ws), 6))
                       for (i, _), h, ws in zip(pairs, held, tokens)), key=repr)
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows), key=repr) == expected
    assert all(r.score < 0 and r.open_score <= r.score + 1e-9 for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id and r.doc_id >= 100]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_common_tokens_change_nothing(spark, monkeypatch):
    docs = documents(spark, edge_pairs() + [(100 + i, prose(i, 40, 90)) for i in range(30)])
    whole = sorted((r.doc_id or -1, round(r.score, 6)) for r in language_model.score_corpus(docs).collect())
    monkeypatch.setattr(language_model, "COMMON", 3)
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in language_model.score_corpus(docs).collect()) == whole


def test_model_without_training_rows(spark):
    held = next(i for i in range(1000) if remainder(i, 10) == 0)
    row = language_model.score_corpus(documents(spark, [(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0
    assert language_model.score_corpus(documents(spark, [])).count() == 0


def test_order_of_words_counts(spark):
    first, second = "the cat sat on a mat by night", "night by mat a on sat cat the"
    trains = [i for i in range(1, 400) if remainder(i, 10)][:60]
    held = [i for i in range(1, 400) if not remainder(i, 10)][:2]
    pairs = [(i, first) for i in trains] + [(held[0], first), (held[1], second)]
    got = {r.doc_id: r for r in language_model.score_corpus(documents(spark, pairs)).collect()}
    assert abs(got[held[0]].base_score - got[held[1]].base_score) < 1e-9
    assert got[held[0]].score > got[held[1]].score + 5


def _letters(spark):
    rng = np.random.default_rng(2)
    docs = documents(spark, [(i, " ".join(rng.choice(["a", "b", "c"], 12)) + f" x{i}") for i in range(40)])
    return docs.selectExpr("doc_id", "text", "doc_id % 10 = 0 AS held_out")


def _model(docs):
    """(model, training counts of pairs by code, kept tables of pairs, counts and probabilities of tokens)."""
    model = language_model.Model(docs.select("text", "held_out"))
    end = language_model._END_HASH
    code, pairs = {}, collections.Counter()
    for row in docs.collect():
        words = row.text.lower().split()
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashes = language_model._tokens(data, np.array([0, len(data)]))[1]
        code.update(zip(words, model.codes.value.of(hashes).tolist()))
        code[None] = int(model.codes.value.of(np.array([end], np.uint64))[0])
        if not row.held_out:
            pairs.update((code[a], code[b]) for a, b in zip([None, *words], [*words, None]))
    tables = {(r.u, r.w): r.kept for r in model.pairs.collect()}
    tokens = {r.code: (r.n, np.array(r.ps)) for r in model.tokens.collect()}
    return model, code, pairs, tables, tokens


def _predict(model, pairs, tables, tokens, u, w):
    """Averaged probability of token ``w`` (None: unknown) after ``u``, by the restaurants' formula."""
    n, ps = tokens.get(w, (0, None))
    total, theta, d = 0.0, pitman_yor.STRENGTH, model.discount
    for s in range(language_model.SAMPLES):
        own = {y: (tables[x, y][s] if c > 1 else 1) for (x, y), c in pairs.items() if x == u}
        served = sum(c for (x, _), c in pairs.items() if x == u)
        p = ps[s] if n else model.unseen[s]
        total += (pairs[u, w] - d * own.get(w, 0) + (theta + d * sum(own.values())) * p) / (theta + served)
    return total / language_model.SAMPLES


@pytest.mark.parametrize("common,bucket", [(1 << 17, 1 << 20), (2, 64), (0, 100)])
def test_scores_follow_from_the_restaurants(spark, monkeypatch, common, bucket):
    monkeypatch.setattr(language_model, "COMMON", common)
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", bucket)
    made = []
    monkeypatch.setattr(language_model, "Model", lambda d, real=language_model.Model: made.append(real(d)) or made[-1])
    docs = _letters(spark)
    scores = {r.doc_id: r.score for r in language_model.score(docs).collect()}
    again = made[-1]
    monkeypatch.setattr(language_model, "Model", lambda d: again)
    model, code, pairs, tables, tokens = _model(docs)
    assert set(tables) == {x for x, c in pairs.items() if c > 1}
    assert all(len(t) == language_model.SAMPLES and all(1 <= x <= pairs[k] for x in t) for k, t in tables.items())
    assert {c for c, (n, _) in tokens.items() if n} == {w for _, w in pairs}
    for row in docs.collect():
        words = [code[x] for x in [None, *row.text.lower().split(), None]]
        expected = sum(math.log10(_predict(model, pairs, tables, tokens, u, w if tokens[w][0] else None))
                       for u, w in zip(words, words[1:]))
        assert abs(scores[row.doc_id] - expected) < 1e-6
    known = [w for w, (n, _) in tokens.items() if n]
    for u in [code[None], code["a"], code["x1"]]:
        assert abs(sum(_predict(model, pairs, tables, tokens, u, w) for w in [*known, None]) - 1) < 1e-6


def test_word_contexts_are_reseated(spark):
    docs = documents(spark, [(i, " ".join(np.random.default_rng(i).choice(["a", "b", "c"], 40))) for i in range(40)])
    model = language_model.Model(docs.selectExpr("text", "false AS held_out"))
    kept = [r.kept for r in model.pairs.collect()]
    assert len(kept) > 9 and any(len(set(k)) > 1 for k in kept)


def test_token_probabilities_sum_to_one():
    words = [b"ab", b"abc", b"b", b""]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0] + [len(w) for w in words])
    cells, word = pitman_yor.spell(data, offsets)
    distinct, inverse = np.unique(cells, return_inverse=True)
    model = pitman_yor.Spelling(distinct, np.bincount(inverse).astype(float), None, 0)
    again = pitman_yor.Spelling(distinct, np.bincount(inverse).astype(float), model, 1)
    for m in (model, again):
        for level in m.levels:
            assert np.allclose(level.reshape(-1, pitman_yor.SYMBOLS).sum(axis=1), 1, atol=1e-3)
    assert word.tolist() == [0] * 3 + [1] * 4 + [2] * 2 + [3]


@pytest.mark.parametrize("discount,weight,n", [(0.5, 0.3, 40), (0.2, 5.0, 3000), (0.7, 60.0, 800)])
def test_seating_has_the_restaurant_distribution(discount, weight, n):
    rng = np.random.default_rng(4)
    exact = []
    for _ in range(400):
        tables = 1
        for seated in range(1, n):
            tables += rng.random() < weight / (weight + seated - discount * tables)
        exact.append(tables)
    got = pitman_yor.seat_any(np.full(4000, n), np.full(4000, weight), discount,
                              rng.integers(0, 1 << 62, 4000).astype(np.uint64), 9)
    assert abs(got.mean() - np.mean(exact)) < 5 * np.std(exact) / 20 + 0.02 * np.mean(exact)
    assert 0.8 < got.std() / np.std(exact) < 1.25


def test_a_sweep_moves_a_row_for_each_bucket_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(language_model, "COMMON", 4)
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 200)
    monkeypatch.setattr(language_model, "CODE_RANGE", 3)
    docs = documents(spark, [(i, " ".join(np.random.default_rng(i).choice(list("abcdefgh"), 40))) for i in range(40)])
    model = language_model.Model(docs.selectExpr("text", "false AS held_out"))
    pairs = model.pairs.collect()
    rows = model.rows.where(f"kind = {language_model._PAIR}").count()
    assert rows <= model.buckets < len(pairs)
    # what is added up by ranges of codes is what the pairs have
    opened = np.zeros((4, language_model.SAMPLES))
    for r in pairs:
        if r.u >= 0:
            opened[r.u] += r.kept
    once = language_model._common_sums(model.counts, 4)[language_model._SINGLES]
    assert (np.column_stack(model.opened) == opened + once[:, None]).all()
