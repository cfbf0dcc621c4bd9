"""The best twelve-word window of a matching text.

Applied to the few dozen winners of a search only. A window scores 1000 for
each phrase it shows for the first time and 1 for each repeat; one that begins
a sentence gets 100 more, one that begins the text 120. Windows are tried
around each match and at the start of each match's sentence.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import analysis

WINDOW = 12
ELLIPSIS = " ... "
# Fixed values of the window ranking.
_NEW, _AGAIN, _SENTENCE, _START = 1000, 1, 100, 120

_PRIVATE = r"\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd"
_WORD = re.compile(rf"(?:[^\W_]|[{_PRIVATE}])(?:[^\W_]|[{_PRIVATE}\u0300-\u0331])*")
_SENTENCE_END = re.compile(r"[.:][ \t\n\r]*\Z")


def _matches(words: list[str], phrases: list[list[str]]) -> list[tuple[int, int]]:
    """(position, phrase) of every occurrence, in text order."""
    return [
        (at, n)
        for at in range(len(words))
        for n, phrase in enumerate(phrases)
        if words[at:at + len(phrase)] == phrase
    ]


def best_window(words: list[str], sentences: list[int], phrases: list[list[str]], size: int) -> int:
    """First word of the best window."""
    found = _matches(words, phrases)
    best, chosen = -1, 0

    def worth(start: int) -> tuple[int, int]:
        """(score of the window at ``start``, where to start to centre its matches)."""
        inside = [(at, n) for at, n in found if start <= at < start + size]
        fresh = len({n for _, n in inside})
        score = _NEW * fresh + _AGAIN * (len(inside) - fresh)
        if not inside:
            return score, start
        last, phrase = inside[-1]
        spare = size - (last + len(phrases[phrase]) - inside[0][0])
        centred = inside[0][0] - int(spare / 2)
        return score, max(min(centred, len(words) - size), 0)

    for at, _ in found:
        score, start = worth(at)
        if score > best:
            best, chosen = score, start
        opening = max((s for s in sentences if s <= at), default=at)
        if len(words) > size and opening < at:
            bonus = _START if opening == 0 else _SENTENCE
            score = worth(opening)[0] + bonus
            if score > best:
                best, chosen = score, opening
    return chosen


def snippet_of(text: str, phrases: list[list[str]], analyser: str, size: int = WINDOW) -> str:
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return text
    words = [analysis.normalise(text[a:b], analyser) for a, b in spans]
    sentences = [i for i, (a, _) in enumerate(spans) if i == 0 or _SENTENCE_END.search(text, spans[i - 1][1], a)]
    first = best_window(words, sentences, phrases, size)
    last = first + size - 1
    head = ELLIPSIS + text[spans[first][0]:] if first else text
    if last >= len(spans) - 1:
        return head
    cut = len(text) - spans[last][1]
    return head[:len(head) - cut] + ELLIPSIS


def snippet(text: Column, phrases: list[list[str]], analyser: str = "porter") -> Column:
    @F.arrow_udf(T.StringType())
    def windows(texts: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else snippet_of(t, phrases, analyser) for t in texts.to_pylist()], pa.string()
        )

    return windows(text)
