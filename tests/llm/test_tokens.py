import collections
import zlib

import numpy as np
import pytest
from helpers import documents, edge_pairs, ordered, prose
from tokenizers import Tokenizer

from textdrift.llm import packing, separators, tokens, words as W


def encode(pairs):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in pairs]


def texts():
    odd = ["don't we'll THEY'RE 'tis ''s x'", "e.g. a-b_c/d (x) [y]{z} 3.14 1,000 $5 100%", "Éé Ünï ß ſ K ½ ① ²",
           "ạ́b ≠ ̸= a≠b", "tab\tnew\nline\x0bvt\x0cff\rcr\x00nul\x1fus", "　wide nbsp ls",
           "!!??..''\"\" ;;", "ﷺ 한국어 हिन्दी ภาษา 😀👍🏽", "<|startoftext|>x<|endoftext|>", "A" * 3000]
    return edge_pairs() + [(100 + i, t) for i, t in enumerate(odd)] + [(200 + i, prose(i, 700)) for i in range(12)]


def test_units_give_the_ids_of_whole_texts(spark):
    import pyarrow as pa
    encoder = tokens.Encoder(tokens.default_tokenizer(), cache_units=50)
    expected = encode(texts())
    for _ in range(2):
        flat, counts = encoder.encode(*W.text_bytes(pa.array([t for _, t in texts()], pa.string())))
        got = np.split(flat, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [ids for _, ids in expected]


@pytest.mark.parametrize("with_ids", [True, False])
def test_packing_keeps_every_id_once_without_padding(spark, with_ids):
    rows = packing.pack(documents(spark, texts()), capacity=512, group_tokens=4000, with_ids=with_ids).collect()
    docs = collections.Counter((i, tuple(ids + [1])) for i, ids in encode(texts()))
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 512 or at & (at - 1) == 0 and at < 512
    if with_ids:
        single = {i: list(t) for (i, t), n in docs.items() if n == 1 and sum(k[0] == i for k in docs) == 1}
        for i, ids in single.items():
            parts = sorted(pieces[i], key=lambda r: r.start)
            assert [x for r in parts for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in parts)
            assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
    else:
        crc = {zlib.crc32(np.array(t[s:s + n], "<u4").tobytes()) for (i, t) in docs
               for s, n in {(r.start, r.length) for r in pieces[i]}}
        assert all(r.ids_crc32 in crc for r in rows)
    total = sum(len(t) * n for (_, t), n in docs.items())
    assert sum(r.length for r in rows) == total


def test_costs_are_balanced():
    lengths = np.random.default_rng(0).integers(1, 900, 500)
    doc, _, size, at, _ = packing.assign(lengths, 1024, 1.0, 1 / 1024)
    cost = np.bincount(at, size + size ** 2 / 1024)
    full = np.bincount(at, size) == 1024
    assert np.bincount(doc, size).tolist() == lengths.tolist()
    assert cost[full].std() < 0.2 * cost[full].mean()


@pytest.mark.parametrize("block,slice_bytes,file_slices", [(7, 300, 2), (1000, 5000, 3), (1 << 16, W.SLICE_BYTES, 8)])
def test_separator_scan_counts_every_document(spark, block, slice_bytes, file_slices):
    docs = documents(spark, texts()).repartition(3)
    rows = separators.token_counts(docs, block=block, slice_bytes=slice_bytes, file_slices=file_slices).collect()
    assert ordered(rows) == ordered((i, len(ids)) for i, ids in encode(texts()))


def test_scan_of_foreign_files(spark, tmp_path):
    def put(name, ids):
        (tmp_path / name).write_bytes(np.array(ids, ">u2").tobytes())
    e = separators.EOD
    put("a.bin", [5, 6, e, e, 7, e, 8, 9, 10])
    put("b.bin", [e])
    put("c.bin", [])
    put("d.bin", [1] * 20)
    rows = separators.scan_token_files(spark, str(tmp_path), block=4).collect()
    assert sorted((r.file[-5:], r.place, r.n_tokens) for r in rows) == [
        ("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 1), ("a.bin", 3, 3), ("b.bin", 0, 0), ("d.bin", 0, 20)]
    (tmp_path / "e.bin").write_bytes(b"odd")
    with pytest.raises(Exception, match="odd number"):
        separators.scan_token_files(spark, str(tmp_path)).collect()


def test_empty_tables(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    assert separators.token_counts(documents(spark, [])).count() == 0
