"""Licence sentences and ordered rules."""

from __future__ import annotations

import textwrap

from pitscore.llm import licenses
from tests.llm.fixtures import documents

S = licenses.SENTENCES


def test_rules(spark):
    texts = {
        1: "Intro text. Licensed under the Apache License, Version 2.0.",
        2: "\n".join([S["mit-grant"], "unknown line", S["mit-notice"], S["mit-warranty"]]),
        3: "\n".join([S["mit-notice"], S["mit-grant"], S["mit-warranty"]]),
        4: "\n".join([S["bsd-grant"], S["bsd-source"], S["bsd-binary"], S["bsd-names"]]),
        5: "\n".join([S["bsd-grant"], S["bsd-source"], S["bsd-binary"]]),
        6: "RELEASED UNDER THE MIT LICENSE! And: this work is licensed under CC BY-NC 4.0",
        7: "This work is licensed under CC BY-NC 4.0\nReleased under the MIT License.",
        8: " ".join([S["gpl-free"], S["gpl-warranty"]]),
        9: "Nothing licensed here.", 10: None,
    }
    got = {r.doc_id: (r.licenses, r.families) for r in licenses.scan(documents(spark, list(texts.items()))).collect()}
    assert got == {
        1: (["Apache-2.0"], ["permissive"]), 2: (["MIT"], ["permissive"]), 3: ([], []), 4: (["BSD-3-Clause"], ["permissive"]), 5: (["BSD-2-Clause"], ["permissive"]),
        6: (["MIT"], ["permissive"]), 7: (["CC-BY-NC-4.0", "MIT"], ["non-commercial", "permissive"]), 8: (["GPL-3.0"], ["copyleft"]), 9: ([], []), 10: ([], []),
    }


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions."""


def test_wrapped_texts(spark):
    texts, expected = [], []
    for sequence, (spdx, _) in licenses.SEQUENCES.items():
        for mark in ("", "# ", "// ", " * ", "-- "):
            parts = [textwrap.wrap(S[x], 72) for x in sequence]
            texts += [("\r\n" if mark == "// " else "\n").join(f"{mark}{x}".rstrip() for p in parts for x in ["Copyright 2024 Someone", "", *p, ""])]
            expected.append([spdx])
    texts += [APACHE, "\n".join(f"# {x}".rstrip() for x in APACHE.split("\n")), " ".join(APACHE.split()), "\n".join(textwrap.wrap(" ".join(APACHE.split()), 70))]
    expected += [["Apache-2.0"]] * 4
    texts += ["Released under\n   the MIT License.\nMore.", "Released under\n\nthe MIT License.", "Released under. The MIT License.", "It is not released under\nthe MIT License."]
    expected += [["MIT"], [], [], []]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[i].licenses for i in range(len(texts))] == expected
    assert [got[len(texts) - i].n_sentences for i in (4, 3, 2, 1)] == [3, 2, 2, 2]
