"""Licence scan: units of a text against licence templates by the Dice coefficient over word bigrams.

A unit is the whole text, a block between empty lines, a line or a sentence.  Beside these, windows of a
template's length are compared wherever its necessary bigrams stand, across line and sentence ends, and
count where no unit with half of their bigrams has matched; of overlapping windows the one that shares
most counts.  The oracle SQL knows units only.  Units and templates are
normalised alike (lower case, other than a-z and 0-9 to one space, ``licence`` to ``license``) and
become sets of word bigrams.  Dice = 2 |A and B| / (|A| + |B|).  With a threshold t a template B can
only match a unit A with  t / (2 - t) <= |A| / |B| <= (2 - t) / t,  so the size of a unit prunes the
templates it is compared with.  As a match also shares at least t / 2 * (|A| + |B|) >= |B| t / (2 - t)
bigrams, it holds one of any |B| - ceil(|B| t / (2 - t)) + 1 bigrams of the template: texts that hold
none of these, over all templates, are done after one look.  Every unit reports its best template.

Rows are independent: there is no shuffle, and the templates are literals of a fixed size.

Defined cases: null and empty texts match nothing; units of less than two words match nothing; equal
units of a text count once; of templates with the same Dice the first by name wins; repeated rows give
repeated results.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm.common import text_of

DICE = 0.8

# Public licence notices and texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"),
    "MIT-licensed": "Licensed under the MIT License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower().replace("licence", "license")).split()


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _necessary(templates: dict[str, str], dice: float) -> list[str]:
    """Bigrams of which every matching unit holds one: the last ones of each template, sorted so that
    bigrams of many templates are chosen last."""
    sets = [_bigrams(t) for t in templates.values()]
    shared = {b: sum(b in s for s in sets) for s in sets for b in s}
    made: dict[str, None] = {}
    for s in sets:
        made |= dict.fromkeys(sorted(s, key=lambda b: (shared[b], b))[:_few(s, dice)])
    return list(made)


def _few(bigrams: list[str], dice: float) -> int:
    return len(bigrams) - math.ceil(len(bigrams) * dice / (2 - dice) - 1e-9) + 1


def _anchors(templates: dict[str, str], dice: float) -> dict[str, list[tuple[int, int]]]:
    """The necessary bigrams of each template, with the places where they stand in it and its number of bigrams."""
    sets = [_bigrams(t) for t in templates.values()]
    shared = {b: sum(b in s for s in sets) for s in sets for b in s}
    made: dict[str, list[tuple[int, int]]] = {}
    for text, s in zip(templates.values(), sets, strict=True):
        words = _words(text)
        for b in sorted(s, key=lambda b: (shared[b], b))[:_few(s, dice)]:
            places = [(j, len(words) - 1) for j in range(len(words) - 1) if f"{words[j]} {words[j + 1]}" == b]
            made[b] = list(dict.fromkeys([*made.get(b, []), *places]))
    return made


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), r"[^a-z0-9]+", " "))


def bigrams(text: Column) -> Column:
    """The different word bigrams of a normalised text."""
    words = F.split(text, " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def units(text: Column) -> Column:
    """The different normalised units of a text."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    every = F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n"), sentences)
    return F.array_distinct(F.transform(every, normalised))


def matches(text: Column, templates: dict[str, str] = TEMPLATES, dice: float = DICE) -> Column:
    """An array of (dice, rank, licence, shared), the best template of each unit that has one."""
    names = sorted(templates)
    known = F.array(*[F.struct(F.lit(-k).alias("rank"), F.lit(name).alias("name"), F.array(*[F.lit(b) for b in _bigrams(templates[name])]).alias("b"))
                      for k, name in enumerate(names)])
    low, high = dice / (2 - dice) - 1e-9, (2 - dice) / dice + 1e-9
    likely = F.arrays_overlap(bigrams(normalised(text)), F.array(*[F.lit(b) for b in _necessary(templates, dice)]))

    def best(unit: Column) -> Column:
        fitting = F.filter(known, lambda t: F.size(unit).between(F.size(t["b"]) * low, F.size(t["b"]) * high))
        common = F.transform(fitting, lambda t: F.struct(F.size(F.array_intersect(unit, t["b"])).alias("shared"), F.size(t["b"]).alias("n"), t["rank"].alias("rank"), t["name"].alias("licence")))
        scored = F.transform(common, lambda t: F.struct((F.lit(2.0) * t["shared"] / (F.size(unit) + t["n"])).alias("dice"), t["rank"].alias("rank"), t["licence"].alias("licence"), t["shared"].alias("shared")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= dice))

    def known_of(every: Column) -> Column:
        return F.filter(F.transform(every, lambda u: F.struct(u["at"].alias("at"), u["b"].alias("b"), best(u["b"]).alias("m"))), lambda u: u["m"].isNotNull())

    def both(found: Column) -> Column:
        more = _windows(text, _anchors(templates, dice), known_of)
        # What a unit has told already is not told again by a window.
        new = F.filter(more, lambda w: ~F.exists(found, lambda u: F.size(F.array_intersect(w["b"], u["b"])) * 2 >= F.size(w["b"])))
        return F.transform(F.concat(found, new), lambda u: u["m"])

    found = known_of(F.transform(F.transform(units(text), bigrams), lambda b: F.struct(F.lit(-1).alias("at"), b.alias("b"))))
    return F.when(likely, _with(found, both))


def _with(value: Column, function) -> Column:
    """function(value), with value worked out once."""
    return F.transform(F.array(value), function)[0]


def _windows(text: Column, anchors: dict[str, list[tuple[int, int]]], scored) -> Column:
    """The windows of a text that match, without those that overlap a stronger one.

    A window runs over any line and sentence ends and has the length of a template; it starts where the
    template would start if a necessary bigram stood in its place."""
    places = F.create_map(*[c for b, found in anchors.items() for c in (
        F.lit(b), F.array(*[F.struct(F.lit(j).alias("j"), F.lit(n).alias("n")) for j, n in found]))])

    def of(pairs: Column) -> Column:
        seen = F.filter(F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: s["p"].isin(*anchors))
        spans = F.array_distinct(F.flatten(F.transform(seen, lambda s: F.transform(
            F.element_at(places, s["p"]), lambda t: F.struct(F.greatest(s["i"] - t["j"], F.lit(0)).alias("at"), t["n"].alias("n"))))))
        made = F.transform(spans, lambda s: F.struct(s["at"].alias("at"), F.array_distinct(F.slice(pairs, s["at"] + 1, s["n"])).alias("b")))
        return _with(scored(made), apart)

    def strength(w: Column) -> Column:
        return F.struct(w["m"]["shared"].alias("shared"), w["m"]["dice"].alias("dice"), (-w["at"]).alias("at"))

    def apart(found: Column) -> Column:
        return F.filter(found, lambda w: ~F.exists(found, lambda v: (v["at"] < w["at"] + F.size(w["b"])) & (w["at"] < v["at"] + F.size(v["b"])) & (strength(v) > strength(w))))

    words = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return _with(_with(F.split(normalised(text), " "), words), of)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (names, sorted, comma-joined), n_matches and best_dice of every row."""
    return (docs.select("doc_id", matches(text_of()).alias("_m"))
            .select("doc_id", F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("_m", lambda m: m["licence"]))), ","), F.lit("")).alias("licences"),
                    F.when(F.col("_m").isNull(), 0).otherwise(F.size("_m")).cast("long").alias("n_matches"),
                    F.coalesce(F.array_max(F.transform("_m", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice")))


def _sql() -> str:
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(b) for b in _bigrams(TEMPLATES[name]))}])" for k, name in enumerate(sorted(TEMPLATES)))
    return f"""
WITH given AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
templates(k, name, b) AS (VALUES {rows}),
raw AS (
  SELECT rid, text AS u FROM given
  UNION ALL SELECT rid, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM given
  UNION ALL SELECT rid, unnest(string_split(text, chr(10))) FROM given
  UNION ALL SELECT rid, unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) FROM given),
cleaned AS (SELECT DISTINCT rid, string_split(trim(regexp_replace(replace(lower(u), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM raw),
units AS (SELECT rid, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM cleaned WHERE len(w) > 1),
scored AS (
  SELECT rid, w, k, name, 2.0::DOUBLE * len(list_intersect(units.b, templates.b)) / (len(units.b) + len(templates.b)) AS dice
  FROM units JOIN templates ON len(units.b) <= 2 * len(templates.b) AND len(templates.b) <= 2 * len(units.b)),
best AS (SELECT rid, w, name, dice FROM scored WHERE dice >= {DICE} QUALIFY row_number() OVER (PARTITION BY rid, w ORDER BY dice DESC, k) = 1),
found AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(*) AS n, max(dice) AS best_dice FROM best GROUP BY rid)
SELECT doc_id, coalesce(licences, '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(best_dice, 0.0::DOUBLE) AS best_dice
FROM given LEFT JOIN found USING (rid)
"""


SQL = _sql()
