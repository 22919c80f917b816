import collections
import re

import pytest
from helpers import documents, edge_pairs, ordered, prose, spaced

from textdrift.llm import licenses, rules


def measured(text):
    w = spaced(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def rule_pairs():
    window = "a b c d e f g h"
    return edge_pairs() + [
        (20, f"{window} x {window}"), (21, f"{window} {window} {window}"), (22, " ".join(["z"] * 30)), (23, window),
        (24, "line one\nline one\n \n\n line one\nline one"), (25, "#*$%&|<> ünï # 漢|字"), (26, f"{window} i"),
        (27, prose(3, 200) + " the of and to in " * 4), (28, "a b c d e f g h a b c d e f g h a")]


def test_counts_match_brute_force(spark):
    rows = rules.judge(documents(spark, rule_pairs())).collect()
    assert ordered(r[:6] for r in rows) == ordered((i, *measured(t)) for i, t in rule_pairs())
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.base_failed and r.kept for r in rows)
    assert rules.judge(documents(spark, [])).count() == 0


def test_threshold_table_decides(spark):
    docs = documents(spark, [(1, " ".join(["word the"] * 2 + prose(1, 30).split())), (2, prose(2, 40) + " #" * 9)])
    loose = [("any", "n_words", "n_words", 0.0, 2.0)]
    assert {r.doc_id: r.kept for r in rules.judge(docs, loose).collect()} == {1: True, 2: True}
    tight = [("symbols", "n_symbols", "n_words", 0.0, 0.1)]
    assert {r.doc_id: r.kept for r in rules.judge(docs, tight).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("make", [rules.judge, licenses.scan])
def test_plans_are_native(spark, make, capsys):
    make(documents(spark, rule_pairs())).explain()
    plan = capsys.readouterr().out
    assert "Project" in plan and not re.search("Python|Arrow|Pandas|Exchange", plan)


def scanned(text):
    w, out = re.findall("[a-z0-9]+", (text or "").lower()), []
    for name, template in licenses.TEMPLATES.items():
        size, stride = licenses.window_shape(template)
        known = set(licenses.template_shingles(template))
        for i in range(0, len(w) - 1, stride):
            part = w[i:i + size]
            if 100 * len({" ".join(part[j:j + 2]) for j in range(len(part) - 1)} & known) >= 80 * len(known):
                out.append(name)
    return ",".join(sorted(set(out))), len(set(out)), len(out)


def test_licenses_match_exact_containment(spark):
    pairs = edge_pairs() + [(100 + i, f"{prose(i, 17 + i)}\n{t}\n{prose(50 + i, 9)}")
                            for i, t in enumerate(licenses.TEMPLATES.values())]
    for i, t in enumerate(licenses.TEMPLATES.values()):
        words = t.upper().split()
        words[len(words) // 2] = "changed"
        pairs += [(200 + i, " ".join(words)), (300 + i, "-".join(t.split()[::-1])), (400 + i, f"{t} {t}"),
                  (500 + i, " ".join(t.split()[:len(words) // 2]))]
    rows = licenses.scan(documents(spark, pairs)).collect()
    assert ordered(rows) == ordered((i, *scanned(t)) for i, t in pairs)
    assert sum(r.n_licenses > 0 for r in rows) >= 2 * len(licenses.TEMPLATES)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_no_match_lacks_all_key_shingles():
    for text in licenses.TEMPLATES.values():
        shingles, keys = licenses.template_shingles(text), licenses.key_shingles(text)
        assert 100 * (len(shingles) - len(keys)) < licenses.CONTAINMENT * len(shingles)
