"""Byte-level BPE: encoding and decoding of whole texts.

Pre-tokenisation uses no regex. Every code point gets a class from an array; with one or two code points of look-ahead it
becomes a symbol, and each symbol is a transition function of a small automaton. Functions compose associatively, and the
automaton has few distinct compositions, so a prefix scan is a lookup in a composition table: blocks are scanned side by side
with numpy, then the block totals, then each position gets its state and says whether a token starts there. Slices between
starts go through a bounded cache of merged pairs.

Nulls and empty texts have no ids and decode to an empty text. Repeated rows are encoded each. Very long texts are scanned
alone; very long slices merge with a heap in n log n. Empty tables give empty ones. Columns named like a result are replaced, others stay, whatever they
are called.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import dropped
from .tokens import released

# Automaton states: nothing open, in letters, numbers, other, white space, a space that joins what follows, and inside a
# contraction with one or two code points to come.
START, LETTER, NUMBER, OTHER, WHITE, JOIN, LEFT1, LEFT2 = range(8)
# Symbols: letter, number, other, white space before white space or the end, a last space, another last white space, the
# apostrophe of a contraction with one or with two letters. FIRST is added for the first code point of a text.
S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_SPACE, S_BLANK, S_APO1, S_APO2 = range(8)
FIRST = 8
BLOCK = 256
#: Code points that are scanned at once.
SCAN = 1 << 18
#: Entries of the cache of merged slices, and the longest slice (code points) that it keeps.
CACHE, CACHED_LENGTH = 100_000, 64


def _step(state: int, symbol: int) -> tuple[int, bool]:
    if symbol >= FIRST:
        return _step(START, symbol - FIRST)[0], True
    if state in (LEFT1, LEFT2):
        return (START if state == LEFT1 else LEFT1), False
    run = {S_LETTER: LETTER, S_NUMBER: NUMBER, S_OTHER: OTHER}.get(symbol)
    if run is not None:
        return run, state not in (run, JOIN)
    if symbol in (S_APO1, S_APO2):
        if state in (OTHER, JOIN):
            return OTHER, False
        return (LEFT1 if symbol == S_APO1 else LEFT2), True
    if symbol == S_WHITE:
        return WHITE, state != WHITE
    return (JOIN if symbol == S_SPACE else START), True


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, composition table, image of each element and state, boundary by state and symbol."""
    functions = [tuple(_step(s, y)[0] for s in range(8)) for y in range(16)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *functions]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in functions:
            if (h := tuple(g[x] for x in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    every = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)
    starts = np.array([[_step(s, y)[1] for y in range(16)] for s in range(8)])
    return np.array([known[f] for f in functions], np.uint16), compose, np.array(every, np.uint8), starts


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 letter, 1 number, 2 other, 3 white space.

    Which code points are letters depends on the Unicode version, so the table is filled once per process from the engine whose
    results are to be matched, one code point at a time.
    """
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, S_OTHER, np.uint8)
    for number, pattern in ((S_LETTER, r"\p{L}"), (S_NUMBER, r"\p{N}"), (S_WHITE, r"\s")):
        found = bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = number
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a token starts. points: code points of texts, one after another; first: where each text starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    element, compose, image, starts = _monoid()
    symbol = _classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    white = symbol == S_WHITE
    # the last white space before something else in the same text
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~begins[1:]
    symbol[last] = np.where(points[last] == 32, S_SPACE, S_BLANK)
    at = np.flatnonzero(points == 39)
    if len(at):
        end = np.append(points, [0, 0])
        inside1 = ~begins[np.minimum(at + 1, n)]
        inside2 = inside1 & ~begins[np.minimum(at + 2, n)]
        a, b = end[at + 1], end[at + 2]
        symbol[at[inside1 & np.isin(a, [ord(c) for c in "stmd"])]] = S_APO1
        two = (b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))
        symbol[at[inside2 & two]] = S_APO2
    symbol[begins[:-1]] += FIRST

    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint16)  # element 0 is the identity
    grid[:n] = element[symbol]
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    before = np.empty_like(grid)  # of all that stands before, within the block
    total = np.zeros(rows, np.uint16)
    for j in range(BLOCK):
        before[j] = total
        total = compose[total, grid[j]]
    # exclusive scan of the block totals, doubling the distance
    entry = np.concatenate([[0], total[:-1]]).astype(np.uint16)
    step = 1
    while step < rows:
        entry[step:] = compose[entry[:-step].copy(), entry[step:]]
        step *= 2
    state = image[compose[entry[None, :], before], START].T.reshape(-1)[:n]
    return np.flatnonzero(starts[state, symbol])


class Vocabulary:
    """Ranks of a byte-level BPE, with a bounded cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def slice_ids(self, piece: str) -> bytes:
        """Ids of one slice as little-endian 32-bit integers."""
        got = self.cache.get(piece)
        if got is None:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            got = np.array([rank] if rank is not None else self.merge(raw), "<u4").tobytes()
            if len(piece) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    def merge(self, raw: bytes) -> list[int]:
        """Always joins the neighbours whose union has the lowest rank, the leftmost first."""
        n, ranks = len(raw), self.ranks
        if n <= 24:  # few pairs: looking at them all is quicker than a heap
            none = len(self.lengths)
            parts = [raw[i : i + 1] for i in range(n)]
            pairs = [ranks.get(raw[i : i + 2], none) for i in range(n - 1)]
            while pairs and (low := min(pairs)) < none:
                i = pairs.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            return [ranks[x] for x in parts]
        end = list(range(1, n + 1))  # of the part that starts here
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            # an entry is void once one of its two parts has grown or gone
            if not alive[i] or (mid := end[i]) >= n or end[mid] != stop or mid >= stop:
                continue
            end[i] = stop
            alive[mid] = 0
            if stop < n:
                left[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := left[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        whole = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        at = boundaries(np.frombuffer(whole.encode("utf-32-le"), "<u4"), firsts)
        stops = np.searchsorted(at, ends).tolist()
        cuts = [*at.tolist(), len(whole)]
        one = self.slice_ids
        get = self.cache.get
        parts = [get(p) or one(p) for p in (whole[a:b] for a, b in zip(cuts, cuts[1:]))]
        return [b"".join(parts[a:b]) for a, b in zip([0, *stops], stops)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First byte of each token."""
        size = self.lengths[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        total = int(offsets[-1] + self.lengths[ids[-1]])
        shift = np.repeat(self.starts[ids] - offsets, np.diff(np.append(offsets, total)))
        return self.flat[shift + np.arange(total)].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _blocks(values: list, size) -> Iterator[tuple[int, int]]:
    """Index ranges of about SCAN in size, one value at least."""
    a = have = 0
    for i, v in enumerate(values):
        if have and have + size(v) > SCAN:
            yield a, i
            a, have = i, 0
        have += size(v)
    if a < len(values):
        yield a, len(values)


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str = "offsets", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the ids of text_col and the first byte of each token.

    Both columns are binary, little-endian unsigned 32-bit integers, four bytes a token (a Spark string has under 2**31 bytes); columns of these names are replaced.
    """
    rest = dropped(df, ids_col, offsets_col)
    names = [c for c in rest.columns if keep is None or c in keep]
    # the text goes along once
    carried = text_col in names and isinstance(rest.schema[text_col].dataType, T.StringType)
    at = names.index(text_col) if carried else len(names)
    source = rest.select(*names, *([] if carried else [rest[text_col].cast("string").alias("text__")]))
    schema = T.StructType([*[rest.schema[c] for c in names], T.StructField(ids_col, T.BinaryType()), T.StructField(offsets_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in released(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in _blocks(texts, len):
                ids = words.encode(texts[a:b])
                starts = [words.offsets(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(ids, pa.binary()), pa.array(starts, pa.binary())], names=[*names, ids_col, offsets_col])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", offsets_col: str = "offsets", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for; null ids give no bytes."""
    rest = dropped(df, bytes_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        i, o = names.index(ids_col), names.index(offsets_col)
        for batch in released(batches):
            ids, starts = batch.column(i).to_pylist(), batch.column(o).to_pylist()
            for a, b in _blocks(ids, lambda x: len(x or b"")):
                out = [words.decode(x, words.offsets(x) if s is None else np.frombuffer(s, "<u4").astype(np.int64)) for x, s in ((np.frombuffer(x or b"", "<u4"), s) for x, s in zip(ids[a:b], starts[a:b]))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(names))), pa.array(out, pa.binary())], names=[*names, bytes_col])

    return rest.mapInArrow(run, schema)
