"""Word, sentence and tag counts of whole texts, as Arrow column functions.

Each function takes a text column and gives a column, like those of ``text.py``. Spark hands a task's
texts over in Arrow batches, several functions of one text in one pass; a text is scanned by ``re``, whose
``[^\\W_]`` is ``[\\p{L}\\p{N}]`` and whose ``\\s`` is ``WS_CHARS``. Nothing is shuffled or collected.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")            # BLEU_TOKEN_RE
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")         # the marks stay with the sentence; they are no words
_SPOKEN_WORD = re.compile(r"[^\W_]\S*")              # the rest of a word from its first letter or digit
_NOT_PLAIN = re.compile(r"[^a-z0-9 ]+")
_TERM = re.compile(r"\w{2,}")                        # TFIDF_TOKEN_RE
_ASCII_ALPHA = re.compile(r"[a-z]+")
_PUNCT = re.compile("[" + re.escape(string.punctuation) + "]")
_DELETED = {c: None for c in range(128) if chr(c) not in string.ascii_lowercase + string.digits + " "}

KNOWN_WORDS = 300_000       # words, and characters in them, that a worker remembers
KNOWN_CHARS = 20_000_000
SLICE_CHARS = 2_000_000     # characters of texts that are counted at once


def _column(fn: Callable, returns: str, text) -> Column:
    """``fn`` of every text that is not NULL (NULL stays NULL)."""
    kind = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[returns]

    def each(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], kind)
    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, returns)(text)


# A class that reaches beyond U+FFFF is tried range by range at every character. Texts rarely do, so the
# patterns below hold the characters up to the highest of these bounds that a text needs.
_BOUNDS = (0x7F, 0xFF, 0xFFFF, sys.maxunicode)
_BEYOND = [re.compile(f"[\\U{b + 1:08x}-\\U{sys.maxunicode:08x}]") for b in _BOUNDS[:-1]]


def _bound(text: str) -> int:
    """The least of ``_BOUNDS`` that no character of ``text`` exceeds."""
    if text.isascii():
        return _BOUNDS[0]
    return next((b for b, beyond in zip(_BOUNDS[1:-1], _BEYOND[1:]) if not beyond.search(text)), _BOUNDS[-1])


@cache
def _letters(category: str, bound: int) -> str:
    """The characters up to ``bound`` of a Unicode category, as the ranges of a character class."""
    letters = [c for c in range(bound + 1) if unicodedata.category(chr(c)).startswith(category)]
    cuts = [0, *[i for i in range(1, len(letters)) if letters[i] != letters[i - 1] + 1], len(letters)]
    spans = [(letters[a], letters[b - 1]) for a, b in zip(cuts, cuts[1:])]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@cache
def _alpha(bound: int) -> re.Pattern:
    """``\\p{L}+`` of texts without characters beyond ``bound``."""
    return re.compile(f"[{_letters('L', bound)}]+")


@cache
def _mention(bound: int) -> re.Pattern:
    """MENTION_RE of ``entities.py``, of texts without characters beyond ``bound``."""
    number, upper, lower = (f"[{_letters(c, bound)}]" for c in ("N", "Lu", "Ll"))
    return re.compile("|".join([r"https?://\S+", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]+",
                                rf"{number}+(?:[.,]{number}+)*", rf"{upper}{lower}+(?: {upper}{lower}+)*"]))


@cache
def _plain_mention(bound: int) -> re.Pattern:
    """The mentions of ``_mention`` that begin with a digit or a capital; a run is taken whole either way, so its
    first character decides which of the two patterns holds."""
    n, u, l = (_letters(c, bound) for c in ("N", "Lu", "Ll"))
    return re.compile(f"[{n}{u}](?:(?<=[{n}])[{n}]*(?:[.,][{n}]+)*|(?<=[{u}])[{l}]+(?: [{u}][{l}]+)*)")


def _mentions(text: str) -> list[str]:
    plain = "@" not in text and "://" not in text
    return (_plain_mention if plain else _mention)(_bound(text)).findall(text)


def mentions(text) -> Column:
    """Distinct lower-cased mentions of a text, in order of first occurrence; NULL text -> none. A text that
    consecutive rows share is read once."""
    def each(texts: pa.Array) -> pa.Array:
        out, last, found = [], None, []
        for t in texts.to_pylist():
            if t != last:
                last, found = t, [] if t is None else list(dict.fromkeys([m.lower() for m in _mentions(t)]))
            out.append(found)
        return pa.array(out, pa.list_(pa.string()))
    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<string>")(text)


def mention_label(mention: str) -> str:
    if mention.startswith(("http://", "https://")):
        return "URL"
    return "EMAIL" if "@" in mention else "NUMBER" if unicodedata.category(mention[0])[0] == "N" else "NAME"


def typed_mentions(text) -> Column:
    """Distinct structs (lower-cased mention, label of the mention as it stands), in order of first occurrence."""
    def each(texts: pa.Array) -> pa.Array:
        found = [[] if t is None else dict.fromkeys((m.lower(), mention_label(m)) for m in _mentions(t))
                 for t in texts.to_pylist()]
        return pa.array([[{"text": m, "label": label} for m, label in f] for f in found],
                        pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())])))
    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<struct<text:string,label:string>>")(text)


def _cleaned(text: str) -> str:
    low = text.lower()
    kept = low.translate(_DELETED) if low.isascii() else _NOT_PLAIN.sub("", low)
    return " ".join(kept.split())


def cleaned(text) -> Column:
    return _column(_cleaned, "string", text)


def without(text, words) -> Column:
    """Words between single spaces that are not in ``words``."""
    drop = frozenset(words)
    return _column(lambda t: " ".join([w for w in t.split(" ") if w not in drop]), "string", text)


def word_count(text) -> Column:
    return _column(lambda t: len(t.split()), "long", text)


def distinct_count(text) -> Column:
    """Distinct words between single spaces; 0 for an empty text."""
    return _column(lambda t: len(set(t.split(" "))) if t else 0, "long", text)


def sentence_length(text) -> Column:
    """struct(n, s, q): number, sum and sum of squares of the words of every sentence that has one;
    a word holds a letter or digit."""
    def each(texts: pa.Array) -> pa.Array:
        n, s, q = [], [], []
        for t in texts.to_pylist():
            sizes = [] if t is None else [k for p in _SENTENCE_END.split(t) if (k := len(_SPOKEN_WORD.findall(p)))]
            n.append(len(sizes))
            s.append(sum(sizes))
            q.append(sum(k * k for k in sizes))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, s, q)], ["n", "s", "q"])
    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "n long, s long, q long")(text)


def _distinct_share(text: str) -> float:
    low = text.lower()
    found = (_ASCII_ALPHA if low.isascii() else _alpha(_bound(low))).findall(low)
    return len(set(found)) / len(found) if found else 0.0


def type_token_ratio(text) -> Column:
    return F.coalesce(_column(_distinct_share, "double", text), F.lit(0.0))


def punct_ratio(text) -> Column:
    """Share of ASCII punctuation among all characters; 0 for a blank text."""
    def share(t: str) -> float:
        return sum(map(t.count, string.punctuation)) / len(t) if t.strip() else 0.0
    return F.coalesce(_column(share, "double", text), F.lit(0.0))


def term_counts(texts: list[str]) -> Counter:
    """Lower-cased tokens of two word characters or more and their adjacent pairs, counted over the texts."""
    found: Counter = Counter()
    for t in texts:
        tokens = _TERM.findall(t.lower())
        found.update(tokens)
        found.update([f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
    return found


def _rule_tag(token: str, lexicon: dict[str, str], suffixes: list[tuple[str, re.Pattern]]) -> str:
    low = token.lower()
    if low in lexicon:
        return lexicon[low]
    kinds = {unicodedata.category(c)[0] for c in token}
    if kinds == {"N"}:
        return "NUM"
    if len(token) == 1 and kinds <= {"P", "S"}:
        return "PUNCT" if kinds == {"P"} else "SYM"
    return next((tag for tag, ending in suffixes if ending.search(low)), "X")


def _distances(parent: np.ndarray, longest: int) -> np.ndarray:
    """Distance of every node to its root, by pointer doubling; no tree has more than ``longest`` nodes. A cycle
    is an error."""
    to, far = parent, (parent != np.arange(len(parent))).astype(np.int64)
    for _ in range(longest.bit_length() + 1):
        if (parent[to] == to).all():
            return far
        far, to = far + far[to], to[to]
    raise ValueError("the heads of a text form a cycle")


def tree_depths(heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, greatest) of the distances to the root in every tree; ``heads`` holds the trees one after
    the other, each with heads from 1 (a root heads itself)."""
    first = np.cumsum(sizes) - sizes
    far = _distances(heads - 1 + np.repeat(first, sizes), int(max(sizes, default=0)))
    total, deepest = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    has = np.flatnonzero(sizes)
    if len(has):
        total[has], deepest[has] = np.add.reduceat(far, first[has]), np.maximum.reduceat(far, first[has])
    return total, deepest


def rule_heads(sizes: np.ndarray) -> np.ndarray:
    """Heads of the rule tagger: position div 2, the first token heads itself."""
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    return np.maximum(place // 2, 1)


def rule_depths(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tree_depths`` of the heads of the rule tagger. A head does not depend on the size of its text, so the
    trees are the beginnings of the largest one."""
    longest = int(max(sizes, default=0))
    far = _distances(rule_heads(np.array([longest])) - 1, longest)
    upto, deepest = np.append(0, np.cumsum(far)), np.append(0, np.maximum.accumulate(far))
    return upto[sizes], deepest[sizes]


class Numbers(dict):
    """A number for each word, in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words between white space of the texts by number, and the text of each."""
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        return words, np.repeat(np.arange(len(texts)), sizes)


class Lists:
    """Lists of small numbers, one for each word."""

    def __init__(self):
        self.values, self.sizes, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        self.values = np.append(self.values, np.fromiter(chain.from_iterable(lists), np.int32))
        self.sizes = np.append(self.sizes, np.fromiter(map(len, lists), np.int64, len(lists)))
        self.ends = np.cumsum(self.sizes)

    def of(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers in the lists of ``words``, one after the other, and the owner of each."""
        n = self.sizes[words]
        shift = self.ends[words] - np.cumsum(n)
        return self.values[np.repeat(shift, n) + np.arange(int(n.sum()))], np.repeat(owner, n)


class _StyleWords:
    """What the counts of a text need to know of its words. No token, sentence mark or run of letters spans
    white space, so a word is looked at once, at its first use, and looked up afterwards. All words are forgotten
    when they are too many."""

    def __init__(self, lexicon: dict[str, str], suffix_rules):
        self.lexicon, self.suffixes = lexicon, [(t, re.compile(p)) for t, p in suffix_rules]
        self.tag_names = Numbers()                         # a handful: the tags of the rules
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.letters, self.tag_of, self.chars = Numbers(), Numbers(), {}, 0
        self.spoken, self.ends, self.marks = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
        self.runs, self.tags = Lists(), Lists()           # runs of letters, by number; tags of the tokens

    def _tag(self, token: str) -> int:
        at = self.tag_of.get(token)
        if at is None:
            at = self.tag_of[token] = self.tag_names[_rule_tag(token, self.lexicon, self.suffixes)]
        return at

    def _add(self, new: list[str]) -> None:
        spoken, ends, marks, runs, tags = [], [], [], [], []
        for w in new:
            if w.isalpha():
                low, found = [w.lower()], [w]
                # lower-casing can bring in marks, which are no letters
                low = low if low[0].isalpha() else _alpha(_bound(low[0])).findall(low[0])
                spoken.append(True)
                ends.append(False)
                marks.append(0)
            else:
                low = w.lower()
                low, found = (_ASCII_ALPHA if low.isascii() else _alpha(_bound(low))).findall(low), _TOKEN.findall(w)
                spoken.append(any(t.isalnum() for t in found))
                ends.append(w[-1] in ".!?")
                marks.append(len(_PUNCT.findall(w)))
            runs.append([self.letters[x] for x in low])
            tags.append([self._tag(t) for t in found])
        self.chars += sum(map(len, new))
        self.spoken, self.ends = np.append(self.spoken, np.array(spoken, bool)), np.append(self.ends, np.array(ends, bool))
        self.marks = np.append(self.marks, np.array(marks, np.int64))
        self.runs.add(runs)
        self.tags.add(tags)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of the texts by number, and the text of each."""
        if len(self.numbers) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._forget()
        before = len(self.numbers)
        words, owner = self.numbers.of(texts)
        if len(self.numbers) > before:
            self._add(list(islice(self.numbers, before, None)))
        return words, owner


_style_words: dict[tuple, _StyleWords] = {}                 # by rules: a worker keeps its words from task to task


def slices(texts: list, size: Callable = len) -> Iterator[list]:
    """The texts in parts of at most ``SLICE_CHARS`` by ``size``, or of one text."""
    part, chars = [], 0
    for t in texts:
        if part and chars + size(t) > SLICE_CHARS:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += size(t)
    yield part


def _sentence_counts(known: _StyleWords, words: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """n, s, q of ``sentence_length`` for each of ``n`` texts."""
    spoken, ends = known.spoken[words], known.ends[words]
    sentence = np.cumsum(ends) - ends + owner               # a new one after an end mark, and in a new text
    size = np.bincount(sentence, spoken).astype(np.int64)
    of = np.zeros(len(size), np.int64)
    of[sentence] = owner
    return [np.bincount(of, size > 0, n), np.bincount(of, size, n), np.bincount(of, size * size, n)]


def _distinct_share_counts(known: _StyleWords, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    runs, of = known.runs.of(words, owner)
    keys = np.sort(of << 32 | runs)
    first = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return np.bincount(first >> 32, minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)


def style_counts(text, tags, lexicon: dict[str, str], suffix_rules, sentences: bool = True, share: bool = True,
                 punct: bool = True, tagged: bool = True, with_depth: bool = True) -> Column:
    """One pass over the words of a text for all that its style needs: struct(present, blank, sl, ttr, punct_ratio, n,
    c, far, deepest). ``present`` says that it is not NULL, ``blank`` that it has no word. ``sl`` is the struct of ``sentence_length``; ``ttr`` and ``punct_ratio`` are those of the functions
    of these names; n, c, far and deepest are of the rule tagger: tokens, tokens of each of ``tags``, and the sum and
    greatest of their distances to the root. What is not asked for is 0; NULL texts have no words."""
    place = {t: i for i, t in enumerate(tags)}
    rules = (tuple(sorted(lexicon.items())), tuple(map(tuple, suffix_rules)))

    def counts(texts: list[str], known: _StyleWords) -> list[np.ndarray]:
        k = len(texts)
        words, owner = known.of(texts)
        none = np.zeros(k, np.int64)
        sl = _sentence_counts(known, words, owner, k) if sentences else [none] * 3
        ttr = _distinct_share_counts(known, words, owner, k) if share else none
        mark_share = np.bincount(owner, known.marks[words], k) / np.maximum([len(t) for t in texts], 1) if punct else none
        size, deepest, far, c = none, none, none, np.zeros((k, len(place)), np.int64)
        if tagged:
            found, of = known.tags.of(words, owner)
            size = np.bincount(of, minlength=k)
            column = np.array([place.get(t, len(place)) for t in known.tag_names] or [0])
            width = len(place) + 1
            c = np.bincount(of * width + column[found], minlength=k * width).reshape(k, width)[:, :-1]
            if with_depth:
                far, deepest = rule_depths(size)
        blank = np.bincount(owner, minlength=k) == 0
        return [blank, *sl, ttr, mark_share, size, c, far, deepest]

    def each(text: pa.Array) -> pa.Array:
        if rules not in _style_words:
            _style_words[rules] = _StyleWords(lexicon, suffix_rules)
        known = _style_words[rules]
        parts = [counts(part, known) for part in slices([t or "" for t in text.to_pylist()])]
        blank, *sl, ttr, mark_share, size, c, far, deepest = [np.concatenate(x) for x in zip(*parts)]
        whole = lambda x: pa.array(x.astype(np.int64))
        rows = pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(place))
        c = pa.ListArray.from_arrays(rows, whole(c.reshape(-1)))
        sl = pa.StructArray.from_arrays([whole(x) for x in sl], ["n", "s", "q"])
        return pa.StructArray.from_arrays([text.is_valid(), pa.array(blank), sl, pa.array(ttr.astype(float)), pa.array(mark_share.astype(float)), whole(size), c,
                                           whole(far), whole(deepest)], ["present", "blank", "sl", "ttr", "punct_ratio", "n", "c", "far", "deepest"])
    each.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "present boolean, blank boolean, sl struct<n: long, s: long, q: long>, ttr double, "
                             "punct_ratio double, n long, c array<long>, far long, deepest long")(text)


def runs(texts: list) -> tuple[list, np.ndarray]:
    """The texts without those that equal the one before, and the place of each text among them."""
    alone = [t for i, t in enumerate(texts) if not i or t != texts[i - 1]]
    new = np.fromiter((not i or t != texts[i - 1] for i, t in enumerate(texts)), np.int64, len(texts))
    return alone, np.cumsum(new) - 1


class TermWeights:
    """TF-IDF of texts over a vocabulary {term: (index, idf)}. Tokens lie within words, so each word is looked at
    once, at its first use, and a pair of tokens is a term if its numbers are those of a known pair."""

    def __init__(self, known: dict[str, tuple[int, float]]):
        self.tokens: dict[str, int] = {}
        number = lambda t: self.tokens.setdefault(t, len(self.tokens))
        pairs = {(number(t.split(" ")[0]) << 32) | number(t.split(" ")[1]): i for t, (i, _) in known.items() if " " in t}
        single = {number(t): i for t, (i, _) in known.items() if " " not in t}
        self.single = np.full(len(self.tokens) + 1, -1, np.int64)      # the last is for tokens of no term
        self.single[list(single)] = list(single.values())
        keys = np.array(list(pairs) or [-1], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_index = keys[order], np.array(list(pairs.values()) or [-1], np.int64)[order]
        self.idf = np.zeros(max((i for i, _ in known.values()), default=-1) + 1)
        for i, idf in known.values():
            self.idf[i] = idf
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.lists, self.chars = Numbers(), Lists(), 0

    def of(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, index, weight) of the terms of each document, a list of texts, by document and index; unit norm."""
        if len(self.numbers) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._forget()
        before = len(self.numbers)
        words, owner = self.numbers.of([t.lower() for d in docs for t in d])
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        if len(self.numbers) > before:
            new = list(islice(self.numbers, before, None))
            self.chars += sum(map(len, new))
            self.lists.add([[self.tokens.get(t, -1) for t in _TERM.findall(w)] for w in new])
        tokens, of = self.lists.of(words, owner)
        tokens = tokens.astype(np.int64)
        first, second = tokens[:-1], tokens[1:]
        near = np.flatnonzero((of[:-1] == of[1:]) & (first >= 0) & (second >= 0))
        wanted = first[near] << 32 | second[near]
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        hit = self.pairs[at] == wanted
        index = np.append(self.single[tokens], self.pair_index[at[hit]])
        of = doc[np.append(of, of[near[hit]])]
        keys, tf = np.unique((of << 32 | index)[index >= 0], return_counts=True)
        of, index = keys >> 32, keys & 0xFFFFFFFF
        w = (1.0 + np.log(tf)) * self.idf[index]
        return of, index, w / np.sqrt(np.bincount(of, w * w, len(docs)))[of]
