"""Words and hashes of runs of words, for a whole Arrow batch at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

_WORDS = re.compile(r"[^\W_]+")  # letters and numbers
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits, case-folded: by way of upper case, so that sharp s equals ss."""
    return _WORDS.findall(text.upper().lower())


class WordHashes(dict):
    """Word to 64-bit hash, remembered for the words of a task up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, flat: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, flat), np.uint64, len(flat))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def rolled(hashes: np.ndarray, run: int) -> np.ndarray:
    """The hash of the ``run`` words that start at each place; the last run - 1 places mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(min(run, len(hashes))):
        part = hashes[k:] if k else hashes
        out[: len(part)] = mixed(out[: len(part)]) + part
    return mixed(out)


def bit_rows(hashes: np.ndarray, owner: np.ndarray, texts: int, bits: int) -> np.ndarray:
    """A bit for each of the hashes of each text: a row of bytes a text."""
    table = np.zeros((texts, bits), bool)
    table[owner, (mixed(hashes) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(table, axis=1)


def bit_columns(hashes: np.ndarray, owner: np.ndarray, texts: int, bits: int) -> list[pa.Array]:
    """``bit_rows`` as columns of 64."""
    return [pa.array(np.ascontiguousarray(c)) for c in bit_rows(hashes, owner, texts, bits).view(np.int64).T]
