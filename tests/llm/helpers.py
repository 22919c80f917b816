"""Small documents for the operators' edge cases, and plain Python versions of what they compute."""

import collections
import hashlib
import random
import re

from pyspark.sql import types as T

#: ``documents`` with columns whose names clash with those the operators make
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()),
                     T.StructField("hash", T.LongType()), T.StructField("key", T.StringType())])
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def spaced(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return SPACED.findall(text)


def documents(spark, pairs):
    rows = [(i, t, ("en", "de", None)[n % 3], None if n % 4 else "src0", "x", 0.5, n, None)
            for n, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, words=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def edge_pairs():
    """Null ids and texts, blanks, repeated rows, one id with two texts, a very long text."""
    return [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (4, "one"), (None, "Null id word"), (None, None),
            (5, "two words"), (5, "other Words here"), (6, prose(1, 40000)), (7, "\x1c odd\x85space ünï — ok"),
            (8, "a,b;c' d's can't ́x é <|endoftext|> 12,5 ÀÉ İ ﬁ 漢字")]


def repeats(pairs, k=35):
    """(doc_id, n_words, n_removed, kept text) of every document."""
    words = [(i, spaced(t)) for i, t in pairs]
    count = collections.Counter(tuple(w[j:j + k]) for _, w in words for j in range(len(w) - k + 1))
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if count[tuple(w[j:j + k])] > 1:
                keep[j:j + k] = [False] * k
        out.append((i, len(w), keep.count(False), " ".join(x for x, y in zip(w, keep) if y)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_classes(pairs, size=4, part=80, whole=100):
    """(doc_id, n_shingles, component_id, class) of every document, by comparing all pairs."""
    sets = []
    for _, t in pairs:
        w = spaced(t, lower=True)
        sets.append({tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(pairs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and whole * common >= part * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(pairs):
        least.setdefault(find(x), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return [(i, len(sets[x]), least[find(x)], find(x)) for x, (i, _) in enumerate(pairs)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
