"""Words and n-gram sets of texts, for Arrow workers."""

from __future__ import annotations

import re

import numpy as np

_WORD = re.compile(r"[^\W_]+")
#: Each ASCII letter in lower case, each digit as it is, all else a blank.
ASCII_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: An odd base and its inverse modulo 2 ** 64: a word's hash is its polynomial, taken out of one sum over all characters.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters that are hashed at a time, about; a longer text is hashed alone.
AT_ONCE = 1 << 17
_POWERS: dict[int, np.ndarray] = {}


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits after lower-casing."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(ASCII_WORDS).decode().split()
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX[0])


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64, at least ``n`` of them."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, AT_ONCE + 1), base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.multiply.accumulate(held)
    return held


def _alphanumeric(code: np.ndarray) -> np.ndarray:
    there = np.zeros(0x110000, bool)
    there[code] = True
    found = np.flatnonzero(there)
    there[found] = [chr(c).isalnum() for c in found.tolist()]
    return there[code]


def _hashes(code: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, which are stretches of characters ``inside``, and the number of words of each text; ``first``: where texts begin."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    value = np.where(inside, mix((code.astype(np.uint64) + np.uint64(1)) * _MIX[0]) if code.itemsize > 1 else _BYTES[code], np.uint64(0))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value * _powers(_BASE, len(code))[: len(code)], out=total[1:])
    return mix((total[end] - total[start]) * _powers(_INVERSE, len(code) + 1)[start]), np.diff(np.append(np.searchsorted(start, first), len(start)))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of each text's words."""
    if all(t.isascii() for t in texts):
        code = np.frombuffer(" ".join(texts).encode().translate(ASCII_WORDS), np.uint8)
        inside, lengths = code != 32, [len(t) for t in texts]
    else:
        low = [t.lower() for t in texts]
        code = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside, lengths = _alphanumeric(code), [len(t) for t in low]
    return _hashes(code, inside, np.concatenate([[0], np.cumsum(np.array(lengths[:-1], np.int64) + 1)]))


def _groups(texts: list[str], at: list[int]) -> list[list[int]]:
    """Places of texts in groups of about AT_ONCE characters."""
    out, held = [[]], 0
    for i in at:
        if out[-1] and held + len(texts[i]) > AT_ONCE:
            out.append([])
            held = 0
        out[-1].append(i)
        held += len(texts[i]) + 1
    return [g for g in out if g]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of every text in order, equal for equal words, and the number of words of each text."""
    given = [t or "" for t in texts]
    plain = [i for i, t in enumerate(given) if t.isascii()]
    rest = [i for i, t in enumerate(given) if not t.isascii()]
    n = np.zeros(len(given), np.int64)
    parts: list[tuple[list[int], np.ndarray]] = []
    for at in (plain, rest):
        for group in _groups(given, at):
            h, m = _word_hashes([given[i] for i in group])
            n[group] = m
            parts.append((group, h))
    flat, begin = np.zeros(int(n.sum()), np.uint64), np.cumsum(n) - n
    for group, h in parts:
        m = n[group]
        flat[np.repeat(begin[group], m) + np.arange(len(h)) - np.repeat(np.cumsum(m) - m, m)] = h
    return flat, n


def gram_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of hashed ``k``-grams of words, one after the other and sorted, and the size of each."""
    flat, n = word_hashes(texts)
    if len(flat) < k:
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    h = np.zeros(len(flat) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * _MIX[0] + flat[i : len(flat) - k + 1 + i])
    row = np.repeat(np.arange(len(n)), n)
    inside = row[: len(h)] == row[k - 1 :]
    h, row = h[inside], row[: len(inside)][inside]
    sorting = (row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(sorting)
    sorting = sorting[order]
    equal = np.flatnonzero(sorting[1:] == sorting[:-1])
    if (h[order[equal]] != h[order[equal + 1]]).any():  # the first 40 bits don't tell some apart
        order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))
