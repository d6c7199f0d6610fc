"""Splitting text into pre-tokens, vectorised.

Both public vocabularies split text by character class: letters (L), numbers (N), white space (S) and the rest (O).
Instead of running a regular expression with Unicode classes, each text becomes an array of classes; the ends of runs
give the cuts, and the few rules on spaces and contractions move some of them.
"""

from __future__ import annotations

from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)

# The contractions of both split patterns.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode properties that the split patterns name."""
    import regex

    at = np.concatenate((np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")))
    text = at.tobytes().decode("utf-32-le")
    table = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    return table


def _runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, classes, and the first position of every run of one class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = classes()[points]
    starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    return points, kind, starts


def _contracted(text: str, kind: np.ndarray, start: np.ndarray) -> None:
    """Joins an apostrophe that stands alone with the letters of a contraction after it."""
    at = text.find("'")
    while at != -1:
        if start[at] and at + 1 < len(text) and kind[at + 1] == LETTER:
            for tail in CONTRACTIONS:
                if text.startswith(tail, at + 1):
                    end = at + 1 + len(tail)
                    start[at + 1] = False
                    if end < len(text):
                        start[end] = True
                    break
        at = text.find("'", at + 1)


def split_bytelevel(text: str) -> list[str]:
    """The matches of the byte-level vocabularies' pattern; joined they give the text again."""
    if not text:
        return []
    points, kind, runs = _runs(text)
    start = np.zeros(len(text), dtype=bool)
    start[runs] = True
    first = runs[kind[runs] == SPACE]
    ends = np.append(runs, len(text))[1:][kind[runs] == SPACE]
    inner = ends < len(text)  # a run at the end of the text stays whole
    first, ends = first[inner], ends[inner]
    start[ends - 1] = True  # of more than one space, the last stands apart
    start[ends[points[ends - 1] == 32]] = False  # and, if plain, leads the next match
    if "'" in text:
        _contracted(text, kind, start)
    cuts = np.flatnonzero(start).tolist()
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def split_words(text: str) -> list[str]:
    """The matches of the lower-case vocabulary's pattern: letters, single numbers, other signs; no white space."""
    if not text:
        return []
    _, kind, runs = _runs(text)
    start = kind == NUMBER
    start[runs] = True
    if "'" in text:
        _contracted(text, kind, start)
    cuts = np.flatnonzero(start)
    ends = np.append(cuts[1:], len(text))
    keep = kind[cuts] != SPACE
    return [text[a:b] for a, b in zip(cuts[keep].tolist(), ends[keep].tolist())]
