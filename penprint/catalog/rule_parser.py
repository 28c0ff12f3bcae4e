"""A small parser for the hook query and tests: the stand-in trees, word by word."""

from __future__ import annotations

import re

from .standins import DEP, POS

_BREAK = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
_WORD = re.compile(r"\w+")


def _parent(i: int, n: int) -> int:
    if n % 2:
        j = n - 1 - i
        return n - 1 - (max(j - 1, 0) // 4)
    return max(i - 1, 0) // 4


def _sentence(words: list[str]) -> dict:
    n = len(words)
    head = [_parent(i, n) for i in range(n)]
    return {
        "text": " ".join(words),
        "head": head,
        "pos": [POS[len(w) % 7] for w in words],
        "dep": ["ROOT" if head[i] == i else DEP[i % 8] for i in range(n)],
        "lower": [w.lower() for w in words],
    }


def make_rule_parser():
    """Called once per task, as a real parser's model load would be."""

    def parse(texts: list[str]) -> list[list[dict]]:
        return [
            [_sentence(w) for w in map(_WORD.findall, _BREAK.split(text)) if w] for text in texts
        ]

    return parse
