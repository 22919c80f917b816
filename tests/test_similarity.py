import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textdrift.functions.lcs import lcs_length
from textdrift.operators import similarity as sm

CH_SCHEMA = ("dataset string, key string, source string, paraphraser string, family string, "
             "T0 string, T1 string, T2 string, T3 string")


def score(spark, t0, t1, t2=None, t3=None, metrics=sm.ALL_METRICS):
    ch = spark.createDataFrame([("d", "k", "s", "palm", "palm", t0, t1, t2, t3)], CH_SCHEMA)
    return sm.score_chains(ch, metrics).first()


def lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def test_lcs_known_cases():
    assert lcs_length(list("abcbdab"), list("bdcaba")) == 4
    assert lcs_length(list("abcde"), list("bxdye")) == 3
    assert lcs_length([], list("abc")) == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_lcs_bit_parallel_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_random_sequences_equal_dp():
    rng = random.Random(7)
    for _ in range(20):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))]
        assert lcs_length(a, b) == lcs_dp(a, b)


def test_bleu_edge_cases(spark):
    r = score(spark, "word", "word", "", "other thing")
    assert r.bleu_T1 == pytest.approx(math.sqrt(0.1))   # one token: p1 = 1, p2 smoothed to 0.1
    assert r.bleu_T2 == 0.0                              # empty hypothesis
    assert r.bleu_T3 == 0.0                              # no shared word


def test_bleu_brevity_and_identity(spark):
    r = score(spark, "the cat sat on the mat", "the cat sat on the mat", "the cat")
    assert r.bleu_T1 == pytest.approx(1.0)
    # hyp "the cat": p1 = 1, p2 = 1, BP = exp(1 - 6/2)
    assert r.bleu_T2 == pytest.approx(math.exp(1 - 3))


def test_rouge_l_and_rouge_n(spark):
    r = score(spark, "a b c d", "b d")
    assert r.rougeL_T1 == pytest.approx(2 / 3)
    assert r.rouge1_T1 == pytest.approx(2 / 3)
    assert r.rouge2_T1 == 0.0
    assert r.rougeL_T2 is None and r.bleu_T3 is None     # missing stages stay NULL


def test_rouge_l_order_sensitive(spark):
    r = score(spark, "a b c d", "d c b a")
    assert r.rouge1_T1 == pytest.approx(1.0)
    assert r.rougeL_T1 == pytest.approx(0.25)


def test_invariants_on_fixture(spark, sf_small):
    from textdrift.plans.catalog import chains
    sc = sm.score_chains(chains(spark, sf_small)).collect()
    assert sc
    for r in sc:
        for s in ("T1", "T2", "T3"):
            vals = [getattr(r, f"{m}_{s}") for m in ("bleu", "rouge1", "rouge2", "rougeL")]
            if vals[0] is None:
                continue
            assert all(0.0 <= v <= 1.0 + 1e-12 for v in vals)
            assert vals[3] <= vals[1] + 1e-12            # ROUGE-L <= ROUGE-1


def test_rouge_l_against_brute_force_on_fixture(spark, sf_small):
    """M4 has no SQL oracle (LCS is too slow in SQL on whole texts): check it by brute force."""
    import re
    from textdrift.plans.catalog import chains
    ch = chains(spark, sf_small).where("paraphraser = 'palm'").limit(30).collect()
    df = spark.createDataFrame([tuple(r) for r in ch], CH_SCHEMA)
    got = {r.key: r for r in sm.score_chains(df, ["rougeL"]).collect()}
    for r in ch:
        ref = re.findall("[a-z0-9]+", r.T0.lower())
        for s in ("T1", "T2", "T3"):
            hyp_text = getattr(r, s)
            if hyp_text is None:
                continue
            hyp = re.findall("[a-z0-9]+", hyp_text.lower())
            lcs = lcs_dp(ref, hyp) if len(ref) * len(hyp) < 4e6 else lcs_length(ref, hyp)
            p = lcs / len(hyp) if hyp else 0.0
            rr = lcs / len(ref) if ref else 0.0
            f = 2 * p * rr / (p + rr) if p + rr > 0 else 0.0
            assert getattr(got[r.key], f"rougeL_{s}") == pytest.approx(f)


def test_embedding_cosine_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])],
                               "ref_vec array<double>, hyp_vec array<double>")
    got = [r.cosine for r in sm.embedding_cosine(df).collect()]
    assert got[0] is None and got[1] == pytest.approx(1.0)


def test_overlap_plans_no_exchange_from_a_stored_table(spark, sf_small, tmp_path, capsys):
    from textdrift.plans.catalog import chains
    path = str(tmp_path / "chains")
    chains(spark, sf_small).write.parquet(path)
    sm.score_chains(spark.read.parquet(path)).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_lcs_of_codes_against_dynamic_program():
    import numpy as np
    from textdrift.functions.lcs import lcs_of_codes
    rng = np.random.default_rng(0)
    for n in range(300):
        a = rng.integers(0, 6, rng.integers(0, 30))
        b = rng.integers(0, 8, rng.integers(0, 30)) if n % 3 else a[rng.random(len(a)) < 0.7]
        assert lcs_of_codes(a, b) == lcs_dp(a.tolist(), b.tolist())


def test_greedy_match_in_blocks_and_without_a_side(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vec = {t: rng.normal(size=(n, 4)) for t, n in ((1, 13), (2, 9))}
    tv = spark.createDataFrame([(t, i, row.tolist()) for t, m in vec.items() for i, row in enumerate(m)],
                               "text_id long, pos long, vec array<double>")
    pairs = spark.createDataFrame([(1, 2, "T1"), (2, 7, "T2")], "ref_id long, hyp_id long, stage string")
    unit = {t: m / np.linalg.norm(m, axis=1, keepdims=True) for t, m in vec.items()}
    sim = unit[1] @ unit[2].T
    for block in (2, 512):
        got = {r.stage: r for r in sm.greedy_match_f1(tv, pairs, block).collect()}
        assert got["T1"].recall == pytest.approx(sim.max(axis=1).mean())
        assert got["T1"].precision == pytest.approx(sim.max(axis=0).mean())
        assert (got["T2"].precision, got["T2"].f1) == (None, None)


def test_greedy_match_skips_tokens_without_a_vector(spark):
    tv = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, None), (2, 0, [1.0, 1.0]), (2, 1, [None, 1.0])],
                               "text_id long, pos long, vec array<double>")
    pairs = spark.createDataFrame([(1, 2, "T1")], "ref_id long, hyp_id long, stage string")
    got = sm.greedy_match_f1(tv, pairs).first()
    assert got.f1 == pytest.approx(math.sqrt(0.5))
    assert [tuple(r) for r in sm.mean_match_by_stage(sm.greedy_match_f1(tv, pairs)).collect()] == [
        ("T1", "BERTSCORE-F1", pytest.approx(math.sqrt(0.5)))]


def test_mean_embedding_cosine_skips_pairs_without_a_side(spark):
    df = spark.createDataFrame([("xsum", "T1", [1.0, 0.0], [1.0, 0.0]), ("wp", "T1", [1.0, 0.0], [0.0, 1.0]),
                                ("wp", "T2", [1.0, 0.0], None)],
                               "dataset string, stage string, ref_vec array<double>, hyp_vec array<double>")
    got = {r.dataset: (r.T0, r.T1, r.T2) for r in sm.mean_embedding_cosine_by_stage(df).collect()}
    assert got == {"xsum": (1.0, 1.0, None), "wp": (1.0, 0.0, None), "all_combined": (1.0, 0.5, None)}
