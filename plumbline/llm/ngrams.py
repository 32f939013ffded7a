"""Words and hashed n-grams of text for the models trained here."""

from __future__ import annotations

import re
import zlib

import numpy as np
import xxhash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Runs of letters and digits (all bytes beyond ASCII count as letters), and runs of other signs.
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(text: str | None) -> np.ndarray:
    """One 32-bit number for each token of the whole text, A-Z lower-cased."""
    tokens = _TOKEN.findall((text or "").encode(errors="surrogatepass").translate(_LOWER))
    return np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))


def word_keys(text: str | None) -> np.ndarray:
    """An even 64-bit number for each token of the whole text, A-Z lower-cased."""
    tokens = _TOKEN.findall((text or "").encode(errors="surrogatepass").translate(_LOWER))
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)) & ~np.uint64(1)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """An odd 64-bit number for each pair of word keys."""
    return ((before * _A) ^ (words * _B)) | np.uint64(1)


def bins(h: np.ndarray, bits: int) -> np.ndarray:
    """Each number's bin, of 2**bits."""
    return ((h * _A) >> np.uint64(64 - bits)).astype(np.int64)


def pair_bins(h: np.ndarray, bits: int) -> np.ndarray:
    """The bins of neighbours (h[i], h[i + 1])."""
    return (((h[:-1] * _A) ^ (h[1:] * _B)) * _A >> np.uint64(64 - bits)).astype(np.int64)


def uniform(seed: str, row_id) -> float:
    """A repeatable number in (0, 1) for a row's id."""
    return ((xxhash.xxh64_intdigest(f"{seed}:{row_id}") >> 12) + 0.5) / (1 << 52)
