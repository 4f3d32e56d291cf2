"""Hashes of words and of word shingles, over batches of texts in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse**i modulo 2**64, for i < n: views of one pair of arrays, as long as the most asked for so far."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))


def _pieces(raw: np.ndarray, space: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about PIECE bytes that end before white space, so that no word is cut."""
    out, at = [], 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            later = np.flatnonzero(space[end : end + PIECE])
            while not len(later) and end < len(raw):
                end += PIECE
                later = np.flatnonzero(space[end : end + PIECE])
            end = end + int(later[0]) if len(later) else len(raw)
        out.append((at, min(end, len(raw))))
        at = out[-1][1]
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lowered, and each text's first word (one more entry)."""
    raw = lower(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _pieces(raw, space):
        blank = space[a:b]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        begin, end = edge[::2], edge[1::2]
        up, down = powers(1 << int(b - a).bit_length())
        with np.errstate(over="ignore"):
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
            hashes.append(mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + a)
    first = np.searchsorted(np.concatenate(starts), text_at)
    return np.concatenate(hashes), first


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a text, and the byte past its last."""
    x = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff((x == 0x20) | ((x >= 0x09) & (x <= 0x0D)), prepend=True, append=True))
    return edge[::2], edge[1::2]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `size` words as ascending hashes; with fewer words the whole sequence is one; without words none."""
    words, first = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        spread = [words * np.uint64(2 * k + 1) + np.uint64(k) for k in range(size)]
        whole = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            whole = mix(whole ^ spread[k][k : k + len(whole)])
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(whole[a : b - size + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for k in range(b - a):
                    one = mix(one ^ spread[k][a + k])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
