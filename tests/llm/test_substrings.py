from helpers import documents, edge_pairs, ordered, prose, repeats, sha

from textdrift.llm import substrings


def pairs():
    shared, long_shared = prose(7, 36), prose(8, 120)
    out = edge_pairs()
    out += [(20 + i, f"{prose(50 + i, 20)} {shared} {prose(70 + i, 9)}") for i in range(6)]
    out += [(40 + i, f"{prose(90 + i, 5)} {' '.join(long_shared.split()[i * 9:i * 9 + 60])}") for i in range(7)]
    out += [(60, long_shared), (61, long_shared), (61, long_shared), (62, f"{shared}\n{shared}"),
            (63, " ".join(["same"] * 80)), (64, prose(99, 34)), (65, prose(99, 34)), (66, prose(7, 35))]
    near = prose(11, 300).split()
    for i in range(30):                                  # a large group of near copies
        copy = list(near)
        copy[(i * 7) % 300] = f"edit{i}"
        out.append((100 + i, " ".join(copy)))
    return out


def test_matches_brute_force(spark):
    rows = substrings.repeated_words(documents(spark, pairs())).collect()
    assert ordered(rows) == ordered((i, n, r, sha(kept)) for i, n, r, kept in repeats(pairs()))


def test_texts_are_cut_and_rows_kept(spark):
    docs = documents(spark, pairs())
    rows = substrings.without_repeats(docs)
    assert rows.schema == docs.schema
    got = ordered((r.doc_id, r.text) for r in rows.collect())
    assert got == ordered((i, kept if removed else text) for (i, text), (_, _, removed, kept)
                          in zip(pairs(), repeats(pairs())))


def test_other_windows_and_empty_table(spark):
    some = [(1, "a b c d e f g h i j x"), (2, "y a b c d e f g h i j"), (3, "a b c d e f g h i"), (4, "a a a a a a a a a a a")]
    rows = substrings.repeated_words(documents(spark, some), window=10).collect()
    assert ordered(rows) == ordered((i, n, r, sha(kept)) for i, n, r, kept in repeats(some, 10))
    assert substrings.repeated_words(documents(spark, [])).count() == 0
