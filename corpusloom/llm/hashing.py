"""Polynomial hashes over byte buffers, vectorised: hashes of words, shingles and substrings."""

from __future__ import annotations

import sys
import types

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: The second kind of hash is taken modulo a prime, with a base of its own.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_276_401_817


def kept() -> dict:
    """What a Python process keeps between calls and tasks.  It is no global of this package, so functions that are sent to workers don't carry it along."""
    return sys.modules.setdefault("_corpusloom_kept", types.ModuleType("_corpusloom_kept")).__dict__


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    tables = kept()
    have = tables.get(("powers", base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, U(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        tables["powers", base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] the sum over j < i of (data[j] + 1) * BASE**j mod 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the substring stands."""
    return (prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start]


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod PRIME."""
    tables = kept()
    have = tables.get(("prime_powers", base))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, have * U(pow(base, len(have), PRIME)) % U(PRIME)])
        tables["prime_powers", base] = have
    return have[:n]


def prime_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 1 << 18) -> np.ndarray:
    """31-bit hashes of data[start:end], the same wherever the substring stands; start ascends.

    Polynomials modulo a prime: what collides modulo 2**64 by its structure doesn't here.  Parts of
    `size` bytes are taken at once, so that the tables stay small.
    """
    out = np.zeros(len(start), np.uint32)
    for lo in range(0, len(data), size):
        a, z = np.searchsorted(start, (lo, lo + size))
        if a == z:
            continue
        s, e = start[a:z] - lo, end[a:z] - lo
        part = data[lo : lo + int(e.max())].astype(np.uint64) + U(1)
        p = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * prime_powers(PRIME_BASE, len(part)) % U(PRIME), out=p[1:])
        back = prime_powers(pow(PRIME_BASE, -1, PRIME), len(part) + 1)[s]
        out[a:z] = (p[e] - p[s]) % U(PRIME) * back % U(PRIME)
    return out
