"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences (at line ends, and after ``.``, ``!`` or ``?`` before white space); a sentence is
normalised to lower-case words of ASCII letters and digits. Known licence sentences have identifiers; one may
wrap over lines, with comment marks at their starts, but not over blank lines or full stops. The
identifiers of a text, in order, are matched against the licence rules: a rule is a sequence of
identifiers that must occur in this order; unknown sentences may lie between.

All of it is one projection: no shuffle, and a text is never split over rows.

Defined results: null and empty texts have no sentence and no licence; every line of a wrapped sentence counts
in ``n_sentences``; repeated rows are scanned each; input columns named like the results are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names as their notices write them -> (SPDX identifier, family).
NAMES = {
    "the MIT License": ("MIT", "permissive"),
    "the ISC License": ("ISC", "permissive"),
    "the BSD 2-Clause License": ("BSD-2-Clause", "permissive"),
    "the BSD 3-Clause License": ("BSD-3-Clause", "permissive"),
    "the Apache License, Version 2.0": ("Apache-2.0", "permissive"),
    "the Boost Software License, Version 1.0": ("BSL-1.0", "permissive"),
    "the Mozilla Public License, Version 2.0": ("MPL-2.0", "weak-copyleft"),
    "the GNU Lesser General Public License, version 2.1": ("LGPL-2.1", "weak-copyleft"),
    "the GNU Lesser General Public License, version 3": ("LGPL-3.0", "weak-copyleft"),
    "the GNU General Public License, version 2": ("GPL-2.0", "copyleft"),
    "the GNU General Public License, version 3": ("GPL-3.0", "copyleft"),
    "the GNU Affero General Public License, version 3": ("AGPL-3.0", "copyleft"),
    "CC0 1.0": ("CC0-1.0", "public-domain"),
    "CC BY 4.0": ("CC-BY-4.0", "permissive"),
    "CC BY-SA 4.0": ("CC-BY-SA-4.0", "copyleft"),
    "CC BY-NC 4.0": ("CC-BY-NC-4.0", "non-commercial"),
    "CC BY-ND 4.0": ("CC-BY-ND-4.0", "no-derivatives"),
    "CC BY-NC-SA 4.0": ("CC-BY-NC-SA-4.0", "non-commercial"),
    "CC BY-NC-ND 4.0": ("CC-BY-NC-ND-4.0", "non-commercial"),
}
# How a short notice begins.
NOTICES = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This file is licensed under", "This software is licensed under")
# Sentences of licence texts and long notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
# Other published forms -> the sentences they stand for.
_APACHE_USE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_COPY = "You may obtain a copy of the License at {}://www.apache.org/licenses/LICENSE-2.0"
FORMS = {
    _APACHE_USE: ("apache-use",),
    **{_APACHE_COPY.format(scheme): ("apache-copy",) for scheme in ("http", "https")},
    **{f"{_APACHE_COPY.format(scheme)} {SENTENCES['apache-warranty']}": ("apache-copy", "apache-warranty") for scheme in ("http", "https")},
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": ("mpl-copy",),
    SENTENCES["isc-grant"].replace("and/or", "and"): ("isc-grant",),
}
# Rules of several sentences, in order -> (SPDX identifier, family).
SEQUENCES = {
    ("mit-grant", "mit-notice", "mit-warranty"): ("MIT", "permissive"),
    ("isc-grant", "isc-warranty"): ("ISC", "permissive"),
    ("bsd-grant", "bsd-source", "bsd-binary"): ("BSD-2-Clause", "permissive"),
    ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"): ("BSD-3-Clause", "permissive"),
    ("apache-use", "apache-copy", "apache-warranty"): ("Apache-2.0", "permissive"),
    ("mpl-form", "mpl-copy"): ("MPL-2.0", "weak-copyleft"),
    ("gpl-free", "gpl-warranty"): ("GPL-3.0", "copyleft"),
    ("unlicense-domain", "unlicense-use"): ("Unlicense", "public-domain"),
}
#: A rule whose licence includes another one's rule hides that.
HIDES = {"BSD-3-Clause": "BSD-2-Clause"}


def normalized(sentence: str) -> str:
    """The sentence as the scan sees it (without the cut at inner full stops)."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate({i: i + 32 for i in range(65, 91)})).strip()


def _known() -> dict[str, str]:
    """Normalised sentence -> identifier; a sentence that the scan cuts in two counts by its last part."""
    known = {}
    for name, text in SENTENCES.items():
        known[normalized(re.split(r"[.!?]+[ \t-\r]", text)[-1])] = name
    for name, (spdx, _) in NAMES.items():
        known.update({normalized(f"{notice} {name}"): f"notice-{spdx}" for notice in NOTICES})
    return known


def rules() -> list[tuple[tuple[str, ...], str, str]]:
    """Identifier sequence, licence, family."""
    return [(s, *v) for s, v in SEQUENCES.items()] + [((f"notice-{spdx}",), spdx, family) for spdx, family in NAMES.values()]


def _forms() -> dict[str, str]:
    """Normalised sentence, in its known and other forms -> identifiers, with commas between."""
    return {normalized(text): ",".join(names) for text, names in FORMS.items()} | _known()


def _lines(text: Column) -> Column:
    """Normalised lines of a text with ``|`` around it and where a full stop or blank line ends a sentence."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz ")
    cut = F.regexp_replace(lower, r"[.!?]+([ \t\x0B-\r]|(\n)|$)", "|$2")
    plain = F.regexp_replace(cut, r"[^a-z0-9\n|]+", " ")
    ends = F.regexp_replace(plain, r"[ \n]*+\|[ \n|]*+|(?: *+\n){2,}+ *+", "|")
    return F.concat(F.lit("|"), F.regexp_replace(ends, r" *+\n *+", "\n"), F.lit("|"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_sentences``, ``identifiers`` (known sentences in order), ``licenses`` and ``families``."""
    known, results = _forms(), ("n_sentences", "identifiers", "licenses", "families")
    names = [f"`{c}`" for c in docs.columns if c not in (*results, "_s")]
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # A blank of a known sentence may be a line end; the longest of those that start at a place counts.
    any_known = "|".join(k.replace(" ", r"[ \n]") for k in sorted(known, key=lambda k: (-len(k), k)))
    found = docs.withColumn("_s", _lines(F.col("text")))
    hits = F.regexp_extract_all("_s", F.lit(rf"(?<=[\n|])(?:{any_known})(?=[\n|])"), F.lit(0))
    hits = F.flatten(F.transform(hits, lambda s: F.split(F.element_at(table, F.translate(s, "\n", " ")), ",")))
    count = F.size(F.filter(F.split("_s", r"[\n|]"), lambda s: F.trim(s) != "")).cast("long")
    found = found.select(*names, count.alias("n_sentences"), hits.alias("identifiers"))
    line = F.concat(F.lit("|"), F.array_join("identifiers", "||"), F.lit("|"))
    matched: dict[str, Column] = {}
    family: dict[str, str] = {}
    for sequence, spdx, kind in rules():
        hit = line.like("%" + "%".join(f"|{s}|" for s in sequence) + "%")
        matched[spdx] = matched[spdx] | hit if spdx in matched else hit
        family[spdx] = kind
    for spdx, hidden in HIDES.items():
        matched[hidden] = matched[hidden] & ~matched[spdx]
    listed = F.array_compact(F.array(*[F.when(matched[s], F.lit(s)) for s in sorted(matched)]))
    kinds = F.array_compact(F.array(*[F.when(matched[s], F.lit(family[s])) for s in sorted(matched)]))
    none = F.array().cast("array<string>")
    some = F.size("identifiers") > 0
    return found.select(
        *names, "n_sentences", "identifiers", F.when(some, listed).otherwise(none).alias("licenses"), F.when(some, F.array_sort(F.array_distinct(kinds))).otherwise(none).alias("families")
    )


def oracle() -> str:
    """The scan of ``documents`` in DuckDB."""
    known = ", ".join(f"({k!r}, {v!r})" for k, v in _known().items())
    by_license: dict[str, list[str]] = {}
    family = {}
    for sequence, spdx, kind in rules():
        by_license.setdefault(spdx, []).append("line like '%" + "%".join(f"|{s}|" for s in sequence) + "%'")
        family[spdx] = kind
    test = {s: "(" + " or ".join(v) + ")" for s, v in by_license.items()}
    for spdx, hidden in HIDES.items():
        test[hidden] = f"({test[hidden]} and not {test[spdx]})"
    listed = ", ".join(f"case when {test[s]} then '{s}' end" for s in sorted(test))
    kinds = ", ".join(f"case when {test[s]} then '{family[s]}' end" for s in sorted(test))
    return rf"""
with known(sentence, id) as (values {known}),
cut as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.!?]+([ \t-\r]|$)', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') as s
  from documents),
parts as (select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) as i from cut),
lines as (select doc_id, string_agg(id, '||' order by i) as ids from parts join known using (sentence) group by doc_id),
marked as (
  select doc_id, len(s)::bigint as n_sentences, coalesce(replace(ids, '||', ','), '') as identifiers,
    '|' || coalesce(ids, '') || '|' as line
  from cut left join lines using (doc_id))
select doc_id, n_sentences, identifiers,
  coalesce(array_to_string(list_filter([{listed}], lambda x: x is not null), ','), '') as licenses,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{kinds}], lambda x: x is not null))), ','), '') as families
from marked"""
