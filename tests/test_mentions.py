"""Mentions and letters of texts by the bound of their characters."""
import random
import re
import unicodedata

from textdrift.functions import words as wd

PIECES = ["Ann Lee", "Élan", "Ünal Örs", "١٢", "½", "3.5", "7,", "Ωmega", "Жук", "𝐀𝐛", "𝟏𝟐", "𐐀𐐨", "😀", "x@y.org",
          "https://Q.z", "ß", " ", "\n", "ª", "ab", "Z"]


def _whole(pattern: str) -> re.Pattern:
    """``pattern`` with the classes of all of Unicode."""
    def of(c):
        return "[" + re.escape("".join(map(chr, (i for i in range(0x110000) if unicodedata.category(chr(i)).startswith(c))))) + "]"
    return re.compile(pattern.replace("{N}", of("N")).replace("{U}", of("Lu")).replace("{l}", of("Ll")).replace("{L}", of("L")))


def test_bounded_patterns_find_what_the_whole_ones_find():
    mention = _whole(r"https?://\S+|[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]+|{N}+(?:[.,]{N}+)*|{U}{l}+(?: {U}{l}+)*")
    letters = _whole(r"{L}+")
    rng, bounds = random.Random(11), set()
    for upto in (2, 4, 8, len(PIECES)):
        for _ in range(150):
            t = rng.choice(["", " "]).join(rng.choices(rng.sample(PIECES, upto), k=rng.randint(0, 10)))
            bounds.add(wd._bound(t))
            assert wd._mentions(t) == mention.findall(t), t
            found = letters.findall(t.lower())
            assert wd._distinct_share(t) == (len(set(found)) / len(found) if found else 0.0), t
    assert bounds == set(wd._BOUNDS)


def test_latin_texts_are_not_matched_against_ranges_beyond_them():
    t = "Café Éric à Zürich 2½"
    assert wd._mentions(t) == ["Café Éric", "Zürich", "2½"]
    assert wd._bound(t) == 0xFF
    patterns = [f(0xFF).pattern for f in (wd._mention, wd._plain_mention, wd._alpha)]
    ends = [int(h, 16) for p in patterns for h in re.findall(r"\\U([0-9a-f]{8})", p)]
    assert ends and max(ends) <= 0xFF
