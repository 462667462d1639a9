"""Words of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are taken at once.
BLOCK = 1 << 18


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what each needed is given back to the system before the next one comes."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space (which is what bytes.split() splits at)."""
    return text.encode().split() if text else []


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` characters, one text at least."""
    a = have = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if have and have + n > most:
            yield a, i
            a, have = i, 0
        have += n
    if a < len(texts):
        yield a, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
