"""License scans by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is looked at as a whole and line by line. A unit is normalised to words of a-z and 0-9, its set of
word bigrams is compared with each licence template's, and a unit matches a template when
``2 * common / (own + template's)`` reaches the threshold. As the common part is no larger than the smaller
set, only templates whose size lies within threshold / (2 - threshold) of the unit's size and the inverse
are compared at all.

A notice may also be wrapped over several lines of a longer text, or stand inside a long line. A template that
neither the whole text nor a line matches is therefore looked for in runs of consecutive words, of up to the
same bound times the template's words. Only texts that have the least common part of a template are searched, and only
runs that begin and end with a bigram of it, as others score no more. A notice found only so counts as one unit.

Null and empty texts and units of one word have no bigrams and match nothing; a line that a text repeats
counts once; results of rows that share an id are taken together, also for a null id; an empty table gives
no rows; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices by which public licences are commonly named or granted. Fixed values.
TEMPLATES = {
    "Apache-2.0 (named)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "BSD (grant)": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 (named)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT (named)": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Words of a-z and 0-9 parted by single blanks, with a blank at either end perhaps."""
    return F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " ")


def pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(words: Column) -> Column:
    return F.array_distinct(pairs(words))


def normalised_words(text: str) -> list[str]:
    return "".join(c if c in _LOWER + "0123456789" else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split()


def template_bigrams(text: str) -> list[str]:
    words = normalised_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _once(name: str, column: Column) -> Column:
    """A column that later steps read more than once, worked out a single time."""
    return F.explode(F.array(column)).alias(name)


def _by_gram(ordered: Column) -> Column:
    """(bigram, place) in order of bigrams, then places from 1 on."""
    return F.array_sort(F.transform(ordered, lambda g, i: F.struct(g.alias("gram"), (i + 1).alias("place"))))


def _marked(by_gram: Column, own: Column) -> Column:
    """Per place of a text: where its bigram stood last before (0 if nowhere), and whether it is one of ``own``."""
    nothing = F.struct(F.lit("").alias("gram"), F.lit(0).alias("place"))
    mark = lambda a, b: F.struct(
        a["place"].alias("place"),
        F.when(a["gram"] == b["gram"], b["place"]).otherwise(0).alias("before"),
        F.array_contains(own, a["gram"]).alias("hit"),
    )
    both = F.zip_with(by_gram, F.concat(F.array(nothing), by_gram), mark)
    return F.array_sort(F.slice(both, 1, F.size(by_gram)))


def _best_run(marked: Column, at: Column, t: Column, low: float) -> Column:
    """The largest coefficient of a run of bigrams that begins and ends at one of the places ``at``; null if there is none.

    A run from i has one distinct bigram more at each place whose bigram stood last before i, so one pass over the
    places from i on counts both sets of all runs from there.
    """
    least = F.ceil(t["size"] * low).cast("int")
    start = F.struct(F.lit(0).alias("own"), F.lit(0).alias("common"), F.lit(None).cast("double").alias("best"))

    def from_place(i: Column) -> Column:
        def longer(run: Column, m: Column) -> Column:
            own = run["own"] + F.when(m["before"] < i, 1).otherwise(0)
            common = run["common"] + F.when((m["before"] < i) & m["hit"], 1).otherwise(0)
            best = F.when(m["hit"], F.greatest(run["best"], 2.0 * common / (own + t["size"]))).otherwise(run["best"])
            return F.struct(own.alias("own"), common.alias("common"), best.alias("best"))

        return F.aggregate(F.slice(marked, i, t["most"]), start, longer, lambda run: run["best"])

    # A run that scores holds the least common part, so places that so many others do not follow near enough are out.
    begins = F.filter(at, lambda i, k: F.get(at, k + least - 1) - i < t["most"])
    return F.array_max(F.transform(begins, from_place))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, units) for each licence that some unit of a document matches."""
    sets = {name: template_bigrams(text) for name, text in (templates or TEMPLATES).items()}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(s) for s in sets.values()]
    most = {name: longest_run(text, threshold) for name, text in (templates or TEMPLATES).items()}
    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("licence"), F.lit(len(s)).alias("size"), F.lit(most[name]).alias("most"), F.array(*map(F.lit, s)).alias("bigrams")
            )
            for name, s in sets.items()
        ]
    )
    anything = F.array(*map(F.lit, sorted(set().union(*sets.values()))))
    # A bigram set has at most one element less than the unit has words, and a word one letter at least, so
    # short units are out before anything is split.
    least = int(low * min(sizes))
    units = docs.select(
        "doc_id", F.posexplode(F.array_distinct(F.concat(F.array("text"), F.split("text", "\n")))).alias("place", "unit")
    ).where(F.length("unit") >= 2 * least + 1)
    # Repeats make sets smaller than texts, so a long unit can only be ruled out by its set. The whole text comes first.
    words = units.select("doc_id", "place", F.split(F.trim(normalised(F.col("unit"))), " ").alias("words"))
    grams = words.select("doc_id", "place", "words", _once("grams", bigrams(F.col("words")))).where(
        (F.col("place") == 0) | F.size("grams").between(int(low * min(sizes)), int(high * max(sizes)) + 1)
    )
    hits = F.when(F.col("place") == 0, F.array_intersect(F.col("grams"), anything)).otherwise(F.array().cast("array<string>"))
    met = grams.select("doc_id", "words", "grams", _once("hits", hits))
    fits = lambda t: (F.size("grams") >= t["size"] * low) & (F.size("grams") <= t["size"] * high)
    within = lambda t: F.size(F.array_intersect(F.col("hits"), t["bigrams"])) >= t["size"] * low
    kinds = F.concat(
        F.transform(F.filter(known, fits), lambda t: F.struct(F.lit(False).alias("inside"), t.alias("t"))),
        F.transform(F.filter(known, within), lambda t: F.struct(F.lit(True).alias("inside"), t.alias("t"))),
    )
    compared = met.select("doc_id", "words", "grams", F.explode(kinds).alias("u")).select("doc_id", "words", "grams", "u.inside", "u.t")
    none = F.array().cast("array<string>")
    ordered = compared.select("doc_id", "grams", "inside", "t", _once("ordered", F.when(F.col("inside"), pairs(F.col("words"))).otherwise(none)))
    sorted_ = ordered.select("doc_id", "grams", "inside", "t", _once("by_gram", _by_gram(F.col("ordered"))))
    marked = sorted_.select("doc_id", "grams", "inside", "t", _once("marked", _marked(F.col("by_gram"), F.col("t.bigrams"))))
    places = F.transform(F.filter("marked", lambda m: m["hit"]), lambda m: m["place"])
    placed = marked.select("doc_id", "grams", "inside", "t", "marked", _once("at", places))
    common = F.size(F.array_intersect(F.col("grams"), F.col("t.bigrams")))
    dice = F.when(F.col("inside"), _best_run(F.col("marked"), F.col("at"), F.col("t"), low)).otherwise(
        2.0 * common / (F.size("grams") + F.col("t.size"))
    )
    scored = placed.select("doc_id", F.col("t.licence").alias("licence"), "inside", dice.alias("dice")).where(F.col("dice") >= threshold)
    unit = F.when(~F.col("inside"), F.col("dice"))
    return scored.groupBy("doc_id", "licence").agg(
        F.coalesce(F.max(unit), F.max("dice")).alias("dice"), F.greatest(F.count(unit), F.lit(1).cast("long")).alias("units")
    )


def longest_run(text: str, threshold: float) -> int:
    """Bigrams of the longest run of words that is compared with a template."""
    return int((2 - threshold) / threshold * (len(normalised_words(text)) - 1))


def licence_sql(threshold: float = THRESHOLD) -> str:
    rows = ", ".join(
        "('{}', {}, [{}])".format(name, longest_run(text, threshold), ", ".join(f"'{g}'" for g in template_bigrams(text)))
        for name, text in TEMPLATES.items()
    )
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {rows}) v(licence, most, own)),
units AS (SELECT DISTINCT doc_id, unit FROM (
  SELECT doc_id, unnest(list_distinct(list_concat([text], string_split(text, chr(10))))) AS unit FROM documents)),
words AS (
  SELECT doc_id, unit, string_split(trim(regexp_replace(translate(unit, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM units),
pairs AS (SELECT doc_id, unit, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS pairs FROM words),
grams AS (SELECT doc_id, unit, list_distinct(pairs) AS g FROM pairs),
scored AS (
  SELECT doc_id, licence, 2e0 * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM grams, templates WHERE len(g) > 0),
texts AS (
  SELECT row_number() OVER () AS r, p.doc_id, pairs
  FROM pairs p JOIN (SELECT DISTINCT doc_id, text FROM documents) d ON d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.text = p.unit),
spread AS (SELECT r, doc_id, unnest(range(1, len(pairs) + 1)) AS place, unnest(pairs) AS gram FROM texts),
places AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY r, gram ORDER BY place), 0) AS before FROM spread),
single AS (SELECT licence, most, len(own) AS size, unnest(own) AS gram FROM templates),
hits AS (SELECT r, place, licence, most, size, gram FROM places JOIN single USING (gram)),
wanted AS (
  SELECT r, licence FROM hits GROUP BY r, licence, size
  HAVING count(DISTINCT gram) >= size * {threshold / (2 - threshold):e}),
starts AS (SELECT r, licence, most, size, place AS i FROM hits JOIN wanted USING (r, licence)),
runs AS (
  SELECT p.doc_id, s.licence, s.size, h.r IS NOT NULL AS hit,
    sum((p.before < s.i)::INT) OVER w AS own, sum((p.before < s.i AND h.r IS NOT NULL)::INT) OVER w AS common
  FROM starts s JOIN places p ON p.r = s.r AND p.place BETWEEN s.i AND s.i + s.most - 1
  LEFT JOIN hits h ON h.r = p.r AND h.place = p.place AND h.licence = s.licence
  WINDOW w AS (PARTITION BY s.r, s.licence, s.i ORDER BY p.place ROWS UNBOUNDED PRECEDING)),
found AS (
  SELECT doc_id, licence, dice AS unit, dice FROM scored
  UNION ALL SELECT doc_id, licence, NULL, 2e0 * common / (own + size) FROM runs WHERE hit)
SELECT doc_id, licence, coalesce(max(unit), max(dice)) AS dice, greatest(count(unit), 1) AS units
FROM found WHERE dice >= {threshold:e} GROUP BY ALL
"""
