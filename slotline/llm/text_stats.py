"""Counts and ratios of one text, made with byte-level C loops and numpy; used by the rule and quality operators."""

from __future__ import annotations

import operator

import numpy as np

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_MARKS = b".,;:!?"
_BREAKS = b" \t\n\x0b\x0c\r"
WINDOW = 8

#: The ratios of ``ratios``, in order.
RATIOS = (
    "symbol", "pipe", "upper", "exclaim", "digit", "mark", "repeat8", "adjacent",
    "dup_line", "word_len", "distinct", "line_len", "symbol_words", "longest",
)


def repeated_positions(words: list[bytes], k: int = WINDOW) -> int:
    """How many words lie in a k-word window that the text holds twice or more.

    Windows are told apart by a rolling 64-bit hash; those whose hash repeats are then compared word by word.
    """
    n = len(words)
    if n <= k:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    m = n - k + 1
    with np.errstate(over="ignore"):
        rolled = np.zeros(m, dtype=np.uint64)
        for i in range(k):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + m]
        rolled ^= rolled >> np.uint64(29)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    groups: dict[tuple, list[int]] = {}
    for at in order[twice].tolist():
        groups.setdefault(tuple(words[at : at + k]), []).append(at)
    edges = np.zeros(n + 1, dtype=np.int64)
    for places in groups.values():
        if len(places) > 1:
            np.add.at(edges, places, 1)
            np.add.at(edges, [p + k for p in places], -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[dict[str, int], list[bytes], bytes]:
    """The rule counts of a text (null: none), its words, and its bytes."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        {
            "n_words": len(words),
            "word_chars": len(text) - (len(raw) - len(raw.translate(None, _BREAKS))),
            "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS.encode())),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": repeated_positions(words),
            "n_lines": len(lines),
        },
        words,
        raw,
    )


def ratios(c: dict[str, int], words: list[bytes], raw: bytes) -> list[float]:
    """``RATIOS`` of a text; all zero for a text without words."""
    n = c["n_words"]
    if not n:
        return [0.0] * len(RATIOS)
    chars = max(1, c["word_chars"])
    share = lambda of: (len(raw) - len(raw.translate(None, of))) / chars
    lengths = list(map(len, words))
    marked = sum(1 for w in words if w[-1:] in b"*#$%&|")
    return [
        c["n_symbols"] / chars,
        raw.count(b"|") / n,
        share(_UPPER),
        raw.count(b"!") / n,
        share(_DIGITS),
        share(_MARKS),
        c["n_repeat_words"] / n,
        sum(map(operator.eq, words, words[1:])) / n,
        c["n_dup_lines"] / max(1, c["n_lines"]),
        c["word_chars"] / n / 10.0,
        # distinct words against what growth with the square root of the length leads one to expect
        len(set(words)) / n * (n / (n + 400.0)) ** 0.1,
        np.log1p(n / max(1, c["n_lines"])) / 5.0,
        marked / n,
        np.log1p(max(lengths)) / 5.0,
    ]
