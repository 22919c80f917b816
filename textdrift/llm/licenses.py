"""Operator 3, license scans: MinHash bands over text windows retrieve license templates.

All built-in expressions over a row, no user function and no shuffle. Words are runs of ASCII
letters and digits of the lower-cased text, shingles are ``SHINGLE`` consecutive words. For a
template of m words the text is cut into overlapping windows, one at every m / 4 words, long
enough that each run of m words lies whole in a window. A window's signature has ``BANDS`` bands
of ``ROWS`` minima; a template that shares a band is retrieved, and matches if the window holds at
least ``CONTAINMENT`` percent of its shingles exactly. A window that holds a template at the
threshold has a Jaccard similarity of about 0.6 or more with it, so that bands miss it with a
probability of about (1 - 0.6^2)^20 = 1e-4, and an exact copy (0.8) with 1e-9.

Texts without any of a template's key shingles are left out before: a match lacks at most 20
percent of the shingles, so it has one of any 20 percent plus one, and the test loses nothing.

Defined results: null, empty and blank texts match nothing; repeated rows are scanned each for
itself; an empty table gives no rows; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT = 2, 16, 80

#: Customary license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of "
                        "the GNU General Public License as published by the Free Software Foundation, either "
                        "version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    w = template_words(text)
    return sorted({" ".join(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})


def window_shape(text: str) -> tuple[int, int]:
    """(words of a window, words between the starts of windows) for a template."""
    m = len(template_words(text))
    stride = max(1, m // 4)
    return m + stride - 1, stride


def key_shingles(text: str) -> list[str]:
    """Shingles of which every match has one: more than may be lacking, the longest ones."""
    shingles = sorted(template_shingles(text), key=lambda s: (-len(s), s))
    least = -(-CONTAINMENT * len(shingles) // 100)
    return shingles[:len(shingles) - least + 1]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _hashes(shingles: Column) -> Column:
    """For each band, the hash of every shingle."""
    def of_band(band: int) -> Column:
        return F.transform(shingles, lambda s: F.xxhash64(F.lit(band), s))
    return F.array(*[of_band(b) for b in range(BANDS)])


def template_bands(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[int]]:
    """The band minima of the templates, computed by the same expressions (a fixed-size table)."""
    row = spark.range(1).select(*[F.transform(_hashes(_strings(template_shingles(t))), F.array_min).alias(n)
                                  for n, t in templates.items()]).first()
    return {n: list(row[n]) for n in templates}


def _window_matches(shingles: Column, hashes: Column, start: Column, size: int, templates: dict[str, str],
                    bands: dict[str, list[int]]) -> Column:
    """Names of the templates that a window matches: retrieved by bands, then verified exactly."""
    own = (start + 1, F.lit(size - SHINGLE + 1))

    def verified(minima: Column) -> Column:
        found = []
        for name, text in templates.items():
            known = template_shingles(text)
            common = F.size(F.array_intersect(F.slice(shingles, *own), _strings(known)))
            found.append(F.when(F.arrays_overlap(minima, F.array(*[F.lit(b).cast("long") for b in bands[name]]))
                                & (100 * common >= CONTAINMENT * len(known)), F.lit(name)))
        return F.array_compact(F.array(*found))
    return _let(F.array(*[F.array_min(F.slice(F.get(hashes, F.lit(b)), *own)) for b in range(BANDS)]), verified)


def _matches(words: Column, templates: dict[str, str], bands: dict[str, list[int]]) -> Column:
    """Names of the templates matched, once for each window. Each shingle is hashed once per band."""
    by_shape: dict[tuple[int, int], dict[str, str]] = {}
    for name, text in templates.items():
        by_shape.setdefault(window_shape(text), {})[name] = text

    def of_shape(shingles: Column, hashes: Column, shape: tuple[int, int], some: dict[str, str]) -> Column:
        starts = F.sequence(F.lit(0), F.size(shingles) - 1, F.lit(shape[1]))
        return F.flatten(F.transform(starts, lambda i: _window_matches(shingles, hashes, i, shape[0], some, bands)))

    def of_shingles(shingles: Column) -> Column:
        return _let(_hashes(shingles), lambda hashes: F.flatten(F.array(*[
            of_shape(shingles, hashes, shape, some) for shape, some in sorted(by_shape.items())])))

    return _let(F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)),
                            lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")), of_shingles)


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licenses (sorted names, comma-joined), n_licenses and n_matches (windows that match,
    summed over templates) of every document."""
    templates = templates or TEMPLATES
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    keys = sorted({k for t in templates.values() for k in key_shingles(t)})
    stems = sorted({max(k.split(), key=len) for k in keys})
    stems = [s for s in stems if not any(o != s and o in s for o in stems)]
    possible = F.lit(False)
    for stem in stems:
        possible = possible | F.contains(text, F.lit(stem))
    pattern = "|".join(k.replace(" ", "[^a-z0-9]+") for k in keys)
    bands = template_bands(documents.sparkSession, templates)
    none = F.array().cast("array<string>")
    words = F.array_remove(F.split(text, "[^a-z0-9]+"), "")
    matches = F.when(possible & text.rlike(pattern), _let(words, lambda w: F.when(F.size(w) < SHINGLE, none).otherwise(
        _matches(w, templates, bands)))).otherwise(none)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _let(matches, lambda m: F.struct(
        F.array_join(F.array_sort(F.array_distinct(m)), ",").alias("licenses"),
        F.size(F.array_distinct(m)).cast("long").alias("n_licenses"), F.size(m).cast("long").alias("n_matches"))).alias(
        "found")).select("doc_id", "found.*")
