"""Hashes of a text's words and word shingles, computed as numpy arrays.

A word's hash mixes two polynomials of its bytes, one modulo 2**64 and one modulo the prime 2**31 - 1: words
built so that the first one agrees whatever its base (Thue-Morse sequences) differ in the second. Texts are taken
whole, in chunks; a word of several chunks mixes the chunks' sums in order. A text without a word has no hashes.
"""

from __future__ import annotations

import functools

import numpy as np

CHUNK = 1 << 20
_U = np.uint64
#: Odd multipliers of the rolling word hash and of the five places in a shingle.
_BASE = _U(0x9E3779B97F4A7C15)
PRIME, _PRIME_BASE = (1 << 31) - 1, 1_234_567_891
_PLACES = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xDB4F0B9175AE2165, 0xBBE0563303A4615F)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    power = np.full(CHUNK + 1, _BASE)
    power[0] = 1
    inverse = np.full(CHUNK + 1, _U(pow(int(_BASE), -1, 1 << 64)))
    inverse[0] = 1
    letters = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    return np.cumprod(power), np.cumprod(inverse), letters, space


@functools.cache
def _prime_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the second base and of its inverse, and the second letters, modulo the prime."""

    def powers(base: int) -> np.ndarray:
        out = np.ones(CHUNK + 1, dtype=np.uint64)
        have = 1
        while have < len(out):  # doubling: the powers after the first ``have`` are those times base**have
            n = min(have, len(out) - have)
            out[have : have + n] = out[:n] * _U(pow(base, have, PRIME)) % _U(PRIME)
            have += n
        return out

    letters = np.random.Generator(np.random.PCG64(17)).integers(1, PRIME, 256, dtype=np.uint64)
    return powers(_PRIME_BASE), powers(pow(_PRIME_BASE, -1, PRIME)), letters


def _second(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' polynomials modulo the prime; ``part`` is a chunk at most, so sums stay far below 2**64."""
    power, inverse, letters = _prime_tables()
    total = np.r_[_U(0), np.cumsum(letters[part] * power[: len(part)] % _U(PRIME))]
    return (total[ends] - total[starts]) % _U(PRIME) * inverse[starts] % _U(PRIME)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word: runs without blanks (space and the bytes 9 to 13), A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    power, inverse, letters, space = _tables()
    out, begin = [], 0
    while begin < len(raw):
        part = np.frombuffer(raw, dtype=np.uint8, count=min(CHUNK, len(raw) - begin), offset=begin)
        blank = space[part]
        if begin + len(part) < len(raw):
            last = np.flatnonzero(blank)
            if not len(last):  # one word longer than a chunk
                end = next((k for k in range(begin + len(part), len(raw)) if space[raw[k]]), len(raw))
                pieces = [np.frombuffer(raw[k : min(k + CHUNK, end)], dtype=np.uint8) for k in range(begin, end, CHUNK)]
                ends = [np.array([0]), *(np.array([len(p)]) for p in pieces)]
                sums = np.array([np.sum(letters[p] * power[: len(p)]) + mix(_second(p, ends[0], e))[0] for p, e in zip(pieces, ends[1:], strict=True)], dtype=np.uint64)
                for k in range(1, len(sums)):
                    sums[:1] = mix(sums[:1]) * _BASE + sums[k : k + 1]
                out.append(sums[:1])
                begin = end
                continue
            part, blank = part[: last[-1] + 1], blank[: last[-1] + 1]
        inside = np.r_[False, ~blank, False]
        starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        total = np.r_[_U(0), np.cumsum(letters[part] * power[: len(part)])]
        out.append((total[ends] - total[starts]) * inverse[starts] + mix(_second(part, starts, ends)))
        begin += len(part)
    return mix(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence if it is shorter."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(width, len(words))
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _U(_PLACES[k % 5])
    return np.unique(mix(total))


def links(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether two sorted sets have 100 * intersection >= ``percent`` * union; empty sets never do."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)
