"""Hashes of words and word shingles, whole batches at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once. A longer text is divided between words; a word longer than this is hashed part by part.
CHUNK = 4 << 20
_BASE = 0x100000001B3
_BACK = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _cut(text: bytes, at: int) -> int:
    """Where to end the bytes hashed from ``at`` on: behind the last blank of the next ``CHUNK``; ``at`` if there is none."""
    if len(text) - at <= CHUNK:
        return len(text)
    blank = _SPACE[np.frombuffer(text, np.uint8, CHUNK, at)][::-1]
    back = int(blank.argmax())
    return at + CHUNK - back if blank[back] else at


def _long_word(text: bytes, start: int) -> tuple[int, int]:
    """The hash, not mixed yet, and the end of the word that begins at ``start``, a part of it at a time."""
    h, at = 0, start
    while at < len(text):
        part = np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)
        blank = _SPACE[part]
        n = int(blank.argmax()) if blank.any() else len(part)
        sum_ = int(((part[:n] + np.uint64(1)) * _power(_BASE, n)).sum(dtype=np.uint64)) if n else 0
        h = (h + sum_ * pow(_BASE, at - start, 1 << 64)) % (1 << 64)
        at += n
        if n < len(part):
            break
    return (h + at - start) % (1 << 64), at


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]] | tuple[int, int]]:
    """Parts of texts, divided between words, with the indexes of their texts, about ``CHUNK`` bytes at a time; and the
    hash and text of each word that is longer than that."""
    parts, owners, held = [], [], 0
    for owner, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = _cut(text, at)
            if parts and (held + end - at > CHUNK or end == at):
                yield parts, owners
                parts, owners, held = [], [], 0
            if end == at:
                h, at = _long_word(text, at)
                yield h, owner
                continue
            parts.append(text[at:end])
            owners.append(owner)
            held += end - at
            at = end
    if parts:
        yield parts, owners


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (bytes between 0x20, 0x09-0x0D) and the index of its text, in order."""
    hashes, units = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for parts, owners in _chunks(texts):
        if isinstance(parts, int):
            hashes.append(mixed(np.array([parts], np.uint64)))
            units.append(np.array([owners]))
            continue
        buffer = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        word = np.concatenate([[False], ~_SPACE[buffer], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer + np.uint64(1)) * _power(_BASE, len(buffer)))])
        h = (total[end] - total[start]) * _power(_BACK, len(buffer) + 1)[start]
        hashes.append(mixed(h + (end - start).astype(np.uint64)))
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        units.append(np.array(owners)[np.searchsorted(starts, start, "right") - 1])
    return np.concatenate(hashes), np.concatenate(units)


def shingle_hashes(words: np.ndarray, units: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row within one unit; a unit with fewer words has one of all its words."""
    if not len(words):
        return words, units
    weight = _power(0x9E3779B97F4A7C15, size + 1)
    inside = np.flatnonzero(units[size - 1 :] == units[: len(units) - size + 1]) if len(units) >= size else np.zeros(0, np.int64)
    h = np.zeros(len(inside), np.uint64)
    for k in range(size):
        h += words[inside + k] * weight[k]
    new = np.concatenate([[True], units[1:] != units[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(units)))
    place = np.arange(len(units)) - np.repeat(first, count)
    short = count < size
    lone = np.add.reduceat(words * weight[np.minimum(place, size)], first)[short]
    return mixed(np.concatenate([h, lone])), np.concatenate([units[inside], units[first[short]]])


def sketches(shingles: np.ndarray, units: np.ndarray, n: int, lanes: int) -> np.ndarray:
    """[n, lanes] float32: each shingle adds +1 or -1 to one lane of its unit's row."""
    lane = (shingles % np.uint64(lanes)).astype(np.int64)
    sign = 1.0 - 2.0 * (shingles >> np.uint64(63)).astype(np.float64)
    return np.bincount(units * lanes + lane, sign, n * lanes).reshape(n, lanes).astype(np.float32)
