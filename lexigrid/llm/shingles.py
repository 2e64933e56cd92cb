"""Word shingles of whole texts as 64-bit hashes, with numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64; fixed values)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int, which: str, base: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n; grown by doubling and kept up to 2 ** 22 values."""
    held = _powers[which]
    while len(held) < n:
        held = np.concatenate((held, held * _U(pow(base, len(held), 1 << 64))))
    if len(held) <= 1 << 22:
        _powers[which] = held
    return held[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of all texts in order, and the number of words of each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    capital = (data >= 65) & (data <= 90)
    data = data + capital.astype(np.uint8) * np.uint8(32)
    inside = np.ones(len(data) + 1, bool)
    inside[0] = False
    inside[1:] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power(n, "up", BASE), out=total[1:])
    words = (total[ends] - total[starts]) * _power(n, "down", pow(BASE, -1, 1 << 64))[starts]
    words = mixed(words ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    limits = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, limits))))
    return words, counts


def folded(start: int, values: np.ndarray) -> np.ndarray:
    """One hash of a short sequence, as an array of one."""
    whole = np.array([start], np.uint64)
    for k in range(len(values)):
        whole = mixed(whole * _U(0xC2B2AE3D27D4EB4F) + values[k : k + 1])
    return whole


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one, one without words none."""
    words, counts = word_hashes(texts)
    factor = [_U(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(width)]
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : len(words) - width + 1 + k] * factor[k] if len(rolled) else _U(0)
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(folded(n, words[at : at + n]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
