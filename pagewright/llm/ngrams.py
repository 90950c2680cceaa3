"""Hashed character n-grams of whole texts with numpy, shared by the language and quality classifiers."""

from __future__ import annotations

import functools
import sys

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def hashed(codes: np.ndarray, sizes: tuple[int, ...], bins: int) -> np.ndarray:
    """The bin of every n-gram of the given sizes; `bins` is a power of two."""
    shift, out, c = np.uint64(64 - bins.bit_length() + 1), [], codes.astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * _MIX
        h ^= h >> np.uint64(29)
        if n in sizes:
            out.append(((h * _MIX) >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def only_letters(text: str) -> np.ndarray:
    """Lower-case code points; each run of anything else is one 0, also before and after. Empty without a letter."""
    c = code_points(text.lower())
    is_letter = letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    c = np.concatenate(([0], np.where(is_letter, c, 0), [0])).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def term_counts(bins_of_text: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins that occur and 1 + ln(count) for each."""
    counts = np.bincount(bins_of_text, minlength=bins)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])
