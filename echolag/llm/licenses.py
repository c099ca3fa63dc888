"""Licence scans: units of a text against licence templates, by the Dice coefficient of their word pairs.

A unit is a line, a paragraph or the whole text. Units and templates are normalised alike (lower case, runs of anything but
letters and digits as one space) and compared as sets of word pairs, A and B, by 2 |A ∩ B| / (|A| + |B|). At least ``t``
needs t / (2 - t) |B| <= |A| <= (2 - t) / t |B|, so the size of a unit's set leaves few templates to compare it with. All of it
happens inside the row, in one pass over the texts.

A licence that no unit shows may still lie inside a longer line or paragraph, or run over several. So the whole text is also
searched for windows of words. At least ``t`` needs t / (2 - t) of a template's pairs to be there, hence some of its longest
pairs, of which a text is asked first; units and windows are compared only with templates whose pairs are there. A template is
compared with every window that can be best: one that begins and ends with runs of the template's pairs, of a size within the
bounds above. That holds for notices and for whole licences, however many of them a text has.

Of windows of several licences that overlap the one with most words in common counts: a shorter notice inside a longer licence
says nothing of its own, in a unit neither. Where a text names another version or variant after the same word (version 2 for version 3, NC-SA for NC), it does not match.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_or_empty

THRESHOLD = 0.8
# a template with more pairs is a whole licence, which speaks of other versions and variants too
WHOLE_PAIRS = 300
# a window is judged with so many more words on either side, where a version or variant may follow
MARGIN = 3

# fixed values: licence notices and short forms
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with'
        " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the'
        " specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


# GNU notices by name in front of "General Public License", word for the work, version
_GNU = {
    "GPL-1.0": ("", "program", "1"),
    "GPL-2.0": ("", "program", "2"),
    "GPL-3.0": ("", "program", "3"),
    "LGPL-2.0": ("Library ", "library", "2"),
    "LGPL-2.1": ("Lesser ", "library", "2.1"),
    "LGPL-3.0": ("Lesser ", "library", "3"),
    "AGPL-3.0": ("Affero ", "program", "3"),
}
# Creative Commons licences by their words
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _add(name: str, *texts: str) -> None:
    known = TEMPLATES.setdefault(name, [])
    known += [t for t in texts if t not in known]


for _name, (_kind, _work, _version) in _GNU.items():
    _full = f"GNU {_kind}General Public License"
    _terms = f"you can redistribute it and/or modify it under the terms of the {_full}"
    _add(
        _name,
        f"This work is licensed under the {_full}, version {_version}",
        f"Licensed under the {_full} v{_version if '.' in _version else _version + '.0'}",
        f"This {_work} is free software: {_terms} as published by the Free Software Foundation, either version {_version} of the"
        " License, or (at your option) any later version.",
        f"This {_work} is free software; {_terms} version {_version} as published by the Free Software Foundation.",
    )
for _name, _kind in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")):
    _full = f"GNU {_kind}General Public License"
    _add(_name, f"Licensed under the {_full}", f"This work is licensed under the {_full}")
for _kind, _title in _CC.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        _add(
            f"CC-{_kind}-{_version}",
            f"Licensed under CC {_kind} {_version}",
            f"This work is licensed under a Creative Commons {_title} {_version} {_scope} License",
        )
_add("BSD-2-Clause", "Licensed under the BSD 2-Clause License")
_add(
    "0BSD",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
)
_add("MIT-0", TEMPLATES["MIT"][2].replace(", subject to the following conditions:", "."))

# whole licences, one file each
BODIES = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
for _name, _text in BODIES.items():
    _add(_name, _text)

# word pairs that part siblings of a family; a text shows the same ones as its template
_FAMILIES = [
    {"gnu general", "gnu lesser", "gnu library", "gnu affero"},
    {f"{a} {b}" for a in ("by", "nc") for b in ("nc", "sa", "nd")}
    | {
        f"{a} {b}"
        for a in ("attribution", "noncommercial")
        for b in ("noncommercial", "sharealike", "noderivatives", "noderivs")
    },
]
_NUMBERED = r"[^ ]+ v?[0-9]{1,2}"
_VERSION = r"(version v?|[^ ]+ v)[0-9]{1,2}"


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def word_pairs(text: str) -> list[str]:
    """The distinct word pairs of a template."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def template_rows(templates: Mapping[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, word pairs) of each template."""
    return [(name, word_pairs(text)) for name, texts in templates.items() for text in texts]


def _marks(pairs: list[str]) -> tuple[list[str], list[str], list[str]]:
    """The pairs that name a version, those that name a variant, and all such pairs of the family.

    A whole licence speaks of others too; there only its version counts.
    """
    numbered = [p for p in pairs if re.fullmatch(_NUMBERED, p)]
    if len(pairs) > WHOLE_PAIRS:
        return [p for p in numbered if p.startswith("version ")], [], []
    words = {w for p in pairs for w in p.split()}
    family = set().union(*(f for f, signs in zip(_FAMILIES, (["gnu"], ["cc", "commons"]), strict=True) if words & {*signs}))
    return numbered, sorted(family & set(pairs)), sorted(family)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(unit: Column) -> Column:
    def of(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 2)
        made = F.transform(places, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
        return F.when(F.size(words) > 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return _let(F.split(unit, " "), of)


def _strings(values: list[str]) -> Column:
    """The values as one literal array; they hold no line feed."""
    return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")


def _pair(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))


def _agrees(pairs: Column, t: Column) -> Column:
    """Whether a text with these pairs names no other version and no other variant than the template."""
    numbered = F.filter(pairs, lambda p: p.rlike(f"^{_NUMBERED}$") & ~F.array_contains(t["numbers"], p))

    def same_word(a: Column, b: Column) -> Column:
        return F.substring_index(a, " ", 1) == F.substring_index(b, " ", 1)

    def other_version(numbered: Column) -> Column:
        # none of the template's numbers after this word, but another
        return F.exists(
            t["numbers"],
            lambda q: F.exists(numbered, lambda p: same_word(p, q))
            & ~F.exists(t["numbers"], lambda r: same_word(r, q) & F.array_contains(pairs, r)),
        )

    versions = F.transform(F.filter(pairs, lambda p: p.rlike(f"^{_VERSION}$")), lambda p: F.regexp_replace(p, ".* v?", ""))
    same_version = (F.size(t["versions"]) == 0) | (F.size(versions) == 0) | F.arrays_overlap(versions, t["versions"])
    named = F.array_sort(F.array_intersect(t["family"], pairs))
    return ~_let(numbered, other_version) & ((F.size(t["family"]) == 0) | (named == t["variants"])) & same_version


def _windows(words: Column, t: Column, threshold: float) -> Column:
    """(first pair, last pair) of the windows that may reach the threshold, in templates of any length.

    A window begins and ends with a run of the template's pairs. A run with a gap behind it that makes up three fifths of both
    begins no window, as the window without them is nearer, and likewise at the end.
    """
    low = threshold / (2 - threshold)
    most = F.floor(t["n"] / low).cast("int") + t["repeats"]
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.array_contains(t["pairs"], _pair(words, i)))

    def runs(at: Column) -> Column:
        # (first place, last place, hits before, hits up to the end)
        starts = F.filter(
            F.transform(at, lambda p, k: F.struct(p.alias("p"), k.alias("k"))),
            lambda s: (s["k"] == 0) | (F.get(at, s["k"] - 1) != s["p"] - 1),
        )

        def run(s: Column, k: Column) -> Column:
            behind = F.coalesce(F.get(starts, k + 1)["k"], F.size(at))
            return F.struct(s["p"].alias("first"), F.get(at, behind - 1).alias("last"), s["k"].alias("before"), behind.alias("upto"))

        return F.transform(starts, run)

    def between(runs: Column) -> Column:
        def worth(r: Column, gap: Column) -> Column:
            return gap.isNull() | ((2 - threshold) * (r["last"] - r["first"] + 1) > threshold * gap)

        indexed = F.transform(
            runs,
            lambda r, k: F.struct(
                r.alias("r"),
                worth(r, F.get(runs, k + 1)["first"] - r["last"] - 1).alias("begins"),
                worth(r, r["first"] - F.when(k > 0, F.get(runs, F.greatest(k - 1, F.lit(0)))["last"]) - 1).alias("ends"),
            ),
        )

        def of(indexed: Column) -> Column:
            begins = F.filter(indexed, lambda x: x["begins"])
            ends = F.filter(indexed, lambda x: x["ends"])

            def from_run(x: Column) -> Column:
                first = x["r"]["first"]
                # as many of the template's pairs as a near text has; repeated ones count once, so there may be more
                near = F.filter(
                    ends,
                    lambda e: (e["r"]["last"] >= first)
                    & (e["r"]["last"] - first + 1 <= most)
                    & (e["r"]["upto"] - x["r"]["before"] >= low * t["n"]),
                )
                return F.transform(near, lambda e: F.struct(first.alias("first"), e["r"]["last"].alias("last")))

            return F.flatten(F.transform(begins, from_run))

        return _let(indexed, of)

    return _let(_let(at, runs), between)


def _overlap(a: Column, b: Column) -> Column:
    return (a["first"] <= b["last"]) & (b["first"] <= a["last"])


def _by_license(scored: Column) -> Column:
    """The best score of each licence, in order of the names."""
    names = F.array_sort(F.array_distinct(F.transform(scored, lambda s: s["license"])))

    def of(name: Column) -> Column:
        own = F.filter(scored, lambda s: s["license"] == name)
        return F.struct(name.alias("license"), F.array_max(F.transform(own, lambda s: s["dice"])).alias("dice"))

    return F.transform(names, of)


def _known(templates: Mapping[str, list[str]], low: float) -> tuple[Column, str]:
    """The templates as an array of structs, and SQL that gives the pair of words at ``w``, ``i`` if a template asks for it.

    At most n - low n of a template's n pairs are absent from a text that holds it, so of ``asked`` pairs ``least`` are there.
    """
    made, vocabulary = [], set()
    for name, texts in templates.items():
        for text in texts:
            pairs = word_pairs(text)
            absent = int(len(pairs) * (1 - low) + 1e-9)
            # long pairs are rare in other texts
            asked = sorted(pairs, key=lambda p: (-len(p), p))[: max(absent + 1, len(pairs) // 2)]
            vocabulary.update(asked)
            numbers, variants, family = _marks(pairs)
            # a GNU notice is of no version that the text contradicts
            versions = sorted({re.sub(".* v?", "", p) for p in numbers if "gnu general" in family and re.fullmatch(_VERSION, p)})
            made.append(
                F.struct(
                    F.lit(name).alias("license"),
                    F.lit(len(pairs)).alias("n"),
                    F.lit(max(0, len(_words(text)) - 1 - len(pairs))).alias("repeats"),
                    F.lit(len(asked) - absent).alias("least"),
                    _strings(pairs).alias("pairs"),
                    _strings(asked).alias("asked"),
                    _strings(numbers).alias("numbers"),
                    _strings(variants).alias("variants"),
                    _strings(family).alias("family"),
                    _strings(versions).alias("versions"),
                )
            )

    def listed(values: set[str]) -> str:
        return ", ".join(f"'{v}'" for v in sorted(values)) or "''"

    pair = "concat_ws(' ', w, get(_words, i + 1))"
    heads = {p.split()[0] for p in vocabulary}
    return F.array(*made), f"CASE WHEN w IN ({listed(heads)}) THEN CASE WHEN {pair} IN ({listed(vocabulary)}) THEN {pair} END END"


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_units, matches) per row; ``matches`` lists (license, dice) of the units' best templates, in text order.

    After them come licences that only windows of words show, each once with its best window. Equal units of a text count once. Null and empty texts have no units. Of templates that are equally near the first by
    name is taken. Long texts are compared whole, repeated rows each on its own. An empty table gives an empty table, and
    other columns are ignored.
    """
    kept = r"\p{L}\p{N}"
    clean = F.regexp_replace(F.lower(text_or_empty(text)), rf"[^{kept}\n]+", " ")
    rows = docs.select("doc_id", clean.alias("_clean"))
    lines = F.split("_clean", "\n")
    paragraphs = F.transform(F.split("_clean", r"\n *\n"), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    whole = F.array(F.replace(F.col("_clean"), F.lit("\n"), F.lit(" ")))
    spaced = F.transform(F.concat(lines, paragraphs, whole), lambda u: F.trim(F.regexp_replace(u, " +", " ")))
    units = F.filter(F.array_distinct(spaced), lambda u: u != "")
    whole_words = F.split(F.trim(F.regexp_replace(F.replace(F.col("_clean"), F.lit("\n"), F.lit(" ")), " +", " ")), " ")
    rows = rows.select("doc_id", units.alias("_units"), whole_words.alias("_words"))

    low = threshold / (2 - threshold)
    known, asked = _known(templates, low)

    def dice(pairs: Column, t: Column) -> Column:
        return 2 * F.size(F.array_intersect(pairs, t["pairs"])) / (F.size(pairs) + t["n"])

    def agreed(pairs: Column, t: Column, context: Column) -> Column:
        """The score of a template, or -1 where it is below the threshold or the context disagrees."""
        return _let(dice(pairs, t), lambda d: F.when(d >= threshold, F.when(_agrees(context, t), d)).otherwise(F.lit(None)))

    hits = F.array_distinct(F.expr(f"filter(transform(_words, (w, i) -> {asked}), p -> p IS NOT NULL)"))
    rows = rows.select("doc_id", "_units", "_words", hits.alias("_hits"))
    # few texts hold enough of a template's longest pairs; in others no unit and no window is near it
    def here(t: Column, number: Column) -> Column:
        held = (F.size("_hits") >= t["least"]) & (F.size(F.array_intersect(F.col("_hits"), t["asked"])) >= t["least"])
        return F.when(held, number)

    none = F.array().cast("array<int>")
    near_by = F.when(F.size("_hits") > 0, F.array_compact(F.transform(known, here))).otherwise(none)
    rows = rows.select("doc_id", "_units", "_words", near_by.alias("_here"))

    def best(pairs: Column, templates: Column) -> Column:
        def score(t: Column) -> Column:
            return F.struct(F.coalesce(agreed(pairs, t, pairs), F.lit(-1.0)).alias("dice"), t["license"].alias("license"))

        near = F.filter(templates, lambda t: (F.size(pairs) >= low * t["n"]) & (F.size(pairs) * low <= t["n"]))
        scored = F.filter(F.transform(near, score), lambda s: s["dice"] >= threshold)
        # of equal scores the first licence by name
        return F.aggregate(
            scored,
            F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("license")),
            lambda a, s: F.when((s["dice"] > a["dice"]) | ((s["dice"] == a["dice"]) & (s["license"] < a["license"])), s).otherwise(a),
        )

    # the templates are one literal, which is named once here and once below, and handed on
    scores = _let(
        F.transform("_here", lambda number: F.get(known, number)),
        lambda templates: F.transform("_units", lambda u: _let(_pairs(u), lambda pairs: best(pairs, templates))),
    )
    found = F.filter(scores, lambda s: s["dice"] >= 0)
    matches = F.transform(found, lambda s: F.struct(s["license"].alias("license"), s["dice"].alias("dice")))
    unmatched = F.array().cast("array<struct<license:string,dice:double>>")
    rows = rows.select(
        "doc_id",
        F.size("_units").cast("long").alias("n_units"),
        F.when(F.size("_here") > 0, matches).otherwise(unmatched).alias("_found"),
        "_words",
        "_here",
    )

    def in_windows(t: Column) -> Column:
        words = F.col("_words")

        def score(w: Column) -> Column:
            pairs = F.array_distinct(F.transform(F.sequence(w["first"], w["last"]), lambda i: _pair(words, i)))
            ends = F.sequence(F.greatest(w["first"] - MARGIN, F.lit(0)), F.least(w["last"] + MARGIN, F.size(words) - 2))
            context = F.transform(ends, lambda i: _pair(words, i))
            scored = _let(pairs, lambda p: agreed(p, t, context))
            return _let(
                scored,
                lambda d: F.struct(
                    t["license"].alias("license"),
                    d.alias("dice"),
                    (d * d * (w["last"] - w["first"] + 1 + t["n"])).alias("weight"),
                    w["first"].alias("first"),
                    w["last"].alias("last"),
                ),
            )

        scored = F.filter(F.transform(_windows(words, t, threshold), score), lambda w: w["dice"].isNotNull())
        # of windows of one template that overlap, the nearest
        return _let(scored, lambda all: F.filter(all, lambda w: ~F.exists(all, lambda o: _overlap(o, w) & (o["dice"] > w["dice"]))))

    windows = F.when(F.size("_here") > 0, F.flatten(F.transform("_here", lambda number: _let(F.get(known, number), in_windows))))
    none = F.array().cast("array<struct<license:string,dice:double,weight:double,first:int,last:int>>")
    rows = rows.select("doc_id", "n_units", "_found", F.coalesce(windows, none).alias("_windows"))

    def overruled(w: Column) -> Column:
        def stronger(o: Column) -> Column:
            heavier = (o["weight"] > w["weight"]) | ((o["weight"] == w["weight"]) & (o["license"] < w["license"]))
            return (o["license"] != w["license"]) & _overlap(o, w) & heavier

        return F.exists("_windows", stronger)

    left = F.filter("_windows", lambda w: ~overruled(w))
    rows = rows.select("doc_id", "n_units", "_found", left.alias("_left"), F.col("_windows.license").alias("_seen"))
    gone = F.array_except("_seen", F.col("_left.license"))
    kept = F.filter("_found", lambda s: ~F.array_contains(gone, s["license"]))
    more = F.filter("_left", lambda w: ~F.array_contains(F.col("_found.license"), w["license"]))
    return rows.select("doc_id", "n_units", F.concat(kept, _by_license(more)).alias("matches"))
