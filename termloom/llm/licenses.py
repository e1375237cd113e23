"""Licence scan: text compared with licence templates by Dice coefficient over word bigrams.

A text is compared as a whole, by its blocks (runs of lines between empty lines) and by its lines, and then by its runs
of words wherever these begin and end, so that a notice in the middle of a sentence, directly before code or spread over several
blocks is found as well as a licence file. All are normalised alike: lower case, and everything that
is neither letter nor digit is a gap. Two sets of bigrams of sizes a and b can reach a coefficient t only if
t / (2 - t) <= a / b <= (2 - t) / t; templates outside of these bounds are pruned before any bigram is compared, and so
are units whose number of words alone rules out every template. For the same reason a match shares at least b t / (2 - t)
bigrams with its template. Words are chosen such that more of each template's bigrams than a match can miss hold
one of them; a text with none of these words cannot match and is not taken apart.

Of the templates that a unit reaches, the one with the highest coefficient names its licence. A run begins where a streak of
bigrams of its template begins, or in a longer streak at every place that is a multiple of the template's size, and ends
with a streak or with the b (2 - t) / t bigrams that it may have at most, repeated ones counted. Runs are
taken only for templates of which the text holds b t / (2 - t) bigrams. A bigram is new in a run if its place before is ahead of the run, so
sizes of runs are counts and no set is built. Of runs that overlap the one that shares more bigrams with its template stays (then
that with the higher coefficient), so that a notice does not also stand for its neighbours (GPL-3.0 for GPL-2.0, BSD-2-Clause for
BSD-3-Clause). Runs add the licences that no unit names, each with its best run as one match; ``OP3_SQL`` knows units only, and runs
are tested against a plain version.

All of it is one projection of built-in expressions: nothing is shuffled, and the templates are a literal.

Cases: a null or empty text matches nothing. Repeated rows give equal results. Equal coefficients go to the licence
named first in order of names. A dense text of notices takes time in proportion to its length. Only ``doc_id`` and ``text`` are read. Parts of less than three words match nothing.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import let, table

THRESHOLD_PERCENT = 80
MATCHES = "array<struct<license:string,shared:int,total:int>>"
RUNS = "array<struct<fewer:int,rank:double,license:string,start:int,end:int,total:int>>"
LONG_WORD = 5  # letters; longer words are looked for anywhere, shorter ones only as whole words
# Wordings of public licences and of the usual notices that refer to one.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version."""],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission."""],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version."""],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version."""],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version."""],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version."""],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software."""],
    "MPL-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
}


def normal_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    """Distinct, in order of appearance."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def prepared(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, bigrams(normal_words(text))) for name in sorted(templates) for text in templates[name]]


def anchor_words(ready: list[tuple[str, list[str]]], percent: int) -> list[str]:
    """Words of which every matching text has at least one, found greedily."""
    open_ = [[set(pair.split()) for pair in own] for _, own in ready]
    # How many pairs of each template must still get an anchor: one more than a match can miss.
    owed = [len(own) - -(-len(own) * percent // (200 - percent)) + 1 for _, own in ready]
    chosen: list[str] = []
    while any(n > 0 for n in owed):
        gain: dict[str, int] = {}
        for pairs, n in zip(open_, owed):
            if n > 0:
                for word in {w for pair in pairs for w in pair}:
                    gain[word] = gain.get(word, 0) + min(n, sum(word in pair for pair in pairs))
        best = max(gain, key=lambda w: (len(w) >= LONG_WORD, gain[w], w))
        chosen.append(best)
        for i, pairs in enumerate(open_):
            left = [pair for pair in pairs if best not in pair]
            owed[i] -= len(pairs) - len(left)
            open_[i] = left
    return chosen


def _pairs(unit: Column) -> Column:
    """Distinct word bigrams of a normalised unit."""
    return let(
        F.split(unit, " "),
        lambda w: F.array_distinct(
            F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        ),
    )


def _runs(unit: Column, known: Column, pairs: list[str], percent: int) -> Column:
    """Array of (license, shared, total): the best run of each licence, of the runs that no better one overlaps."""

    def of_template(t: Column, own: Column, before: Column) -> Column:
        """(shared, rank, license, start, end, total) of the best run from each start."""
        reach = F.floor(t["n"] * (200 - percent) / percent).cast("int")
        every = F.sequence(F.lit(0), F.size(own) - 1)

        def in_streaks(flags: Column) -> Column:
            first = F.filter(every, lambda i: F.get(flags, i) & ~F.coalesce(F.get(flags, i - 1), F.lit(False)))
            last = F.filter(every, lambda i: F.get(flags, i) & ~F.coalesce(F.get(flags, i + 1), F.lit(False)))
            return let(first, lambda begins: let(last, lambda ends: from_starts(flags, begins, ends)))

        def from_starts(flags: Column, begins: Column, ends: Column) -> Column:
            starts = F.flatten(
                F.transform(
                    begins,
                    lambda a, k: F.transform(
                        F.sequence(a, F.get(ends, k), t["n"]), lambda s: F.struct(s.alias("s"), k.alias("k"))
                    ),
                )
            )
            held = lambda x: F.size(F.filter(F.slice(flags, x["s"] + 1, reach), lambda f: f))
            likely = F.filter(starts, lambda x: held(x) * (200 - percent) >= t["n"] * percent)
            return F.filter(
                F.transform(likely, lambda x: best_from(x["s"], x["k"], flags, ends)), lambda run: run.isNotNull()
            )

        def best_from(s: Column, k: Column, flags: Column, ends: Column) -> Column:
            limit = s + reach - 1
            stops = F.filter(
                F.concat(F.slice(ends, k + 1, reach), F.array(limit)), lambda e: (e >= s) & (e <= limit) & F.get(flags, e)
            )

            def scored(e: Column) -> Column:
                return let(
                    F.filter(F.sequence(s, e), lambda i: F.get(before, i) < s),
                    lambda new: F.struct(
                        F.size(F.filter(new, lambda i: F.get(flags, i))).alias("shared"),
                        (F.size(new) + t["n"]).alias("total"),
                        e.alias("end"),
                    ),
                )

            fit = F.filter(F.transform(stops, scored), lambda x: x["shared"] * 200 >= x["total"] * percent)
            ranked = F.transform(
                fit,
                lambda x: F.struct(
                    (-x["shared"] / x["total"]).alias("rank"), (-x["shared"]).alias("fewer"), x["end"].alias("end"), x["total"].alias("total")
                ),
            )
            return let(
                F.array_min(ranked),
                lambda m: F.when(
                    m.isNotNull(),
                    F.struct(
                        m["fewer"].alias("fewer"), m["rank"].alias("rank"), t["name"].alias("license"),
                        s.alias("start"), m["end"].alias("end"), m["total"].alias("total"),
                    ),
                ),
            )

        return let(F.transform(own, lambda x: F.array_contains(t["own"], x)), in_streaks)

    def apart(ranked: Column) -> Column:
        """The runs in order that overlap none before them."""
        kept = F.aggregate(
            ranked,
            F.array().cast(RUNS),
            lambda acc, run: F.when(
                F.exists(acc, lambda k: (k["start"] <= run["end"]) & (run["start"] <= k["end"])), acc
            ).otherwise(F.concat(acc, F.array(run))),
        )
        ordered = F.array_sort(
            F.transform(kept, lambda m: F.struct(m["license"], m["rank"], (-m["fewer"]).alias("shared"), m["total"]))
        )
        best = let(ordered, lambda r: F.filter(r, lambda m, i: ~F.get(r, i - 1)["license"].eqNullSafe(m["license"])))
        return F.transform(best, lambda m: F.struct(m["license"], m["shared"], m["total"]))

    def places_before(own: Column) -> Column:
        """Of each bigram the place before where it also stands, or -1."""
        sorted_places = F.array_sort(F.transform(own, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def linked(p: Column) -> Column:
            both = F.transform(
                p,
                lambda one, k: F.struct(
                    one["i"].alias("i"),
                    F.when(F.get(p, k - 1)["x"] == one["x"], F.get(p, k - 1)["i"]).otherwise(F.lit(-1)).alias("b"),
                ),
            )
            return F.transform(F.array_sort(both), lambda one: one["b"])

        return let(sorted_places, linked)

    def searched(own: Column) -> Column:
        def among(near: Column) -> Column:
            found = let(
                places_before(own), lambda before: F.flatten(F.transform(near, lambda t: of_template(t, own, before)))
            )
            return F.when(F.size(near) > 0, let(F.array_sort(found), apart)).otherwise(F.array().cast(MATCHES))

        held = F.array_distinct(F.filter(own, lambda x: x.isin(*pairs)))
        near = let(
            held,
            lambda h: F.filter(
                known,
                lambda t: (F.size(h) * (200 - percent) >= t["n"] * percent)
                & (F.size(F.array_intersect(h, t["own"])) * (200 - percent) >= t["n"] * percent),
            ),
        )
        return let(near, among)

    words = F.split(unit, " ")
    in_order = let(
        words, lambda w: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    )
    return let(in_order, searched)


def matches(text: Column, templates: dict[str, list[str]] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> Column:
    """Array of (license, shared, total) of a text's units and runs: the coefficient is 2 x shared / total."""
    ready = prepared(templates)
    known = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.array(*[F.lit(x) for x in own]).alias("own"), F.lit(len(own)).alias("n"))
            for name, own in ready
        ]
    )
    sizes = [len(own) for _, own in ready]
    # A unit of w words has at most w - 1 bigrams; a repeated one counts once, so there is no upper bound by words.
    least = min(sizes) * percent / (200 - percent)
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\n]+", " "))
    blocks = F.split(plain, r"\n *\n")
    lines = F.split(plain, "\n")
    tidy = F.transform(
        F.concat(F.array(plain), F.when(F.size(blocks) > 1, blocks).otherwise(F.array().cast("array<string>")), lines),
        lambda u: F.trim(F.replace(u, F.lit("\n"), F.lit(" "))),
    )
    units = F.array_distinct(F.transform(tidy, lambda u: F.regexp_replace(u, " +", " ")))

    def compared(unit: Column) -> Column:
        def scored(own: Column) -> Column:
            n = F.size(own)
            fit = F.filter(
                known, lambda t: (n * (200 - percent) >= t["n"] * percent) & (t["n"] * (200 - percent) >= n * percent)
            )
            scores = F.transform(
                fit,
                lambda t: F.struct(
                    t["name"].alias("license"),
                    F.size(F.array_intersect(own, t["own"])).alias("shared"),
                    (n + t["n"]).alias("total"),
                ),
            )
            reached = F.filter(scores, lambda s: s["shared"] * 200 >= s["total"] * percent)
            ranked = F.transform(
                reached, lambda m: F.struct((-m["shared"] / m["total"]).alias("rank"), m["license"], m["shared"], m["total"])
            )
            return let(F.array_min(ranked), lambda m: F.struct(m["license"], m["shared"], m["total"]))

        return let(_pairs(unit), scored)

    wordy = F.filter(units, lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit(""))) >= max(2, least))
    pairs = sorted({pair for _, own in ready for pair in own})

    def with_runs(found: Column) -> Column:
        names = F.transform(found, lambda m: m["license"])
        more = F.filter(_runs(F.get(units, 0), known, pairs, percent), lambda m: ~F.array_contains(names, m["license"]))
        return F.concat(found, more)

    best = F.filter(F.transform(wordy, compared), lambda m: m["license"].isNotNull())
    found = let(best, with_runs)
    anchors = anchor_words(ready, percent)
    short = "|".join(word for word in anchors if len(word) < LONG_WORD)
    token = rf"(?<![\p{{L}}\p{{N}}])(?:{short})(?![\p{{L}}\p{{N}}])"

    def anchored(small: Column) -> Column:
        tests = [F.contains(small, F.lit(word)) for word in anchors if len(word) >= LONG_WORD]
        return reduce(or_, [*tests, small.rlike(token)] if short else tests)

    hit = let(F.lower(F.coalesce(text, F.lit(""))), anchored)
    return F.when(hit, found).otherwise(F.array().cast(MATCHES))


def scanned(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, licenses (names found, in order), best_license, best_percent (rounded down), n_matches (units with a licence, and licences by runs alone)."""
    found = F.col("found")
    ordered = F.array_sort(
        F.transform(
            found,
            lambda m: F.struct(
                (-F.floor(m["shared"] * 20000 / m["total"])).alias("rank"), m["license"].alias("license")
            ),
        )
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), matches(docs["text"], templates, percent).alias("found"))
    best = F.get("ordered", 0)
    return rows.select("doc_id", "found", ordered.alias("ordered")).select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"]))), ",").alias("licenses"),
        best["license"].alias("best_license"),
        (-best["rank"] / 100).cast("double").alias("best_percent"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _literal(own: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in own) + "]"


_READY = prepared(TEMPLATES)
OP3_SQL = rf"""
WITH t AS (SELECT unnest([{', '.join(f"'{n}'" for n, _ in _READY)}]) AS name,
                  unnest([{', '.join(_literal(own) for _, own in _READY)}]) AS own),
d AS (SELECT row_number() OVER () AS r, doc_id,
        lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')) AS plain FROM documents),
p AS (SELECT r, plain, string_split_regex(plain, '\n *\n') AS blocks, string_split(plain, chr(10)) AS lines FROM d),
u AS (SELECT DISTINCT r, trim(regexp_replace(replace(unit, chr(10), ' '), ' +', ' ', 'g')) AS unit FROM (
        SELECT r, unnest(list_concat([plain], CASE WHEN len(blocks) > 1 THEN blocks ELSE [] END, lines)) AS unit FROM p)),
w AS (SELECT r, unit, string_split(unit, ' ') AS words FROM u),
g AS (SELECT r, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own
      FROM w WHERE len(words) > {max(2, min(len(own) for _, own in _READY) * THRESHOLD_PERCENT / (200 - THRESHOLD_PERCENT))}),
m AS (SELECT r, unit, t.name, len(list_intersect(g.own, t.own)) AS shared, len(g.own) + len(t.own) AS total
      FROM g JOIN t ON len(g.own) * {200 - THRESHOLD_PERCENT} >= len(t.own) * {THRESHOLD_PERCENT}
                   AND len(t.own) * {200 - THRESHOLD_PERCENT} >= len(g.own) * {THRESHOLD_PERCENT}),
h AS (SELECT r, name, floor(shared * 20000 / total)::BIGINT AS pct FROM m WHERE shared * 200 >= total * {THRESHOLD_PERCENT}
      QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY shared / total DESC, name) = 1),
b AS (SELECT r, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(pct) AS pct FROM h GROUP BY r),
n AS (SELECT r, min(name) AS best FROM h JOIN b USING (r) WHERE h.pct = b.pct GROUP BY r)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best AS best_license, pct / 100 AS best_percent
FROM d LEFT JOIN b USING (r) LEFT JOIN n USING (r)
"""
