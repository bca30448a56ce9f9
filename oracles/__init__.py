"""Reference SQL for the registered queries, composed from named common table expressions."""

from __future__ import annotations

import re

from oracles.ctes import CTES
from oracles.finals import FINALS

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def _needed(text: str, seen: dict[str, None]) -> None:
    """Add the expressions that ``text`` mentions, each after the ones it mentions itself."""
    for word in _WORD.findall(text):
        if word in CTES and word not in seen and CTES[word] is not text:
            _needed(CTES[word], seen)
            seen.setdefault(word)


def oracle(name: str) -> str:
    needed: dict[str, None] = {}
    _needed(FINALS[name], needed)
    parts = ",\n".join(f"{n} as materialized ({CTES[n].strip()})" for n in needed)
    return (f"with {parts}\n" if parts else "") + FINALS[name].strip()


def all_oracles() -> dict[str, str]:
    return {name: oracle(name) for name in FINALS}
