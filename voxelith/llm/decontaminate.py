"""Benchmark decontamination by pigeonhole edit matching.

Texts are words (runs of letters, digits and underscores, in lower case). A document holds a test item if some stretch of its words is within
floor(rate * n) edits (words put in, left out or replaced) of the item's n words. The item is cut into one piece more than edits
are allowed; one piece at least then stands unchanged in the stretch. Pieces are looked up by hash wherever all words are known from the
items; around each hit Myers' bit-parallel search decides.

Items are taken in blocks of bounded size, each broadcast, with a pass over the documents for each block. Null and empty items are held by
nothing; null and empty documents hold nothing. Equal items are each reported; repeated documents give repeated rows. Empty tables hold nothing and are held by
nothing; very long texts are searched whole. Of places with equally few edits the first is told, from its shortest stretch. Only ids and texts are read, whatever
other columns are called.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import blocks, mixed, odd_numbers, released

#: Bytes of item text in a block.
BLOCK_BYTES = 16 << 20
_words = re.compile(r"\w+")
_K = odd_numbers(4096, 29)


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _words.findall(text)] if text else []


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 ranges that make up range(n), as even as can be."""
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:]))


def search(masks: dict, n: int, words: list) -> tuple[int, int]:
    """The least number of edits between n pattern words and any stretch of words, and where the first such stretch ends.

    masks: for each pattern word, a bit for each place at which it stands. Bits of `up` and `down` are the vertical differences of a column.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(words, 1):
        eq = masks.get(w, 0)
        keep = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(keep | up) & full
        minus = up & keep
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        diag = eq | down
        up = (minus | ~(diag | plus)) & full
        down = plus & diag & full
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """Test items with an index of their pieces."""

    def __init__(self, items: list[tuple], rate: float):
        self.ids, self.words, self.budget, self.masks = [], [], [], []
        self.known: dict[str, int] = {}
        at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            number = len(self.ids)
            budget = int(rate * len(words) + 1e-9)
            self.ids.append(key)
            self.words.append(words)
            self.budget.append(budget)
            masks: dict[str, int] = defaultdict(int)
            for i, w in enumerate(words):
                masks[w] |= 1 << i
                self.known.setdefault(w, len(self.known) + 1)
            self.masks.append(dict(masks))
            numbers = np.array([self.known[w] for w in words], np.uint64)
            for a, b in pieces(len(words), budget):
                if a < b:
                    at[b - a][int(self._hash(numbers[a:b], b - a, np.zeros(1, np.int64))[0])].append((number, a))
        self.by_length = {}
        for length, found in at.items():
            keys = np.array(sorted(found), np.uint64)
            self.by_length[length] = (keys, [found[int(k)] for k in keys])

    @staticmethod
    def _hash(numbers: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for i in range(length):
            total = mixed(total + numbers[at + i] * _K[i % len(_K)])
        return total

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, place in the item) of each piece; numbers: 0 for unknown words and between documents."""
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        for length, (keys, found) in self.by_length.items():
            if length > len(numbers):
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            hashed = self._hash(numbers, length, at)
            i = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            for p, k in zip(at[keys[i] == hashed].tolist(), i[keys[i] == hashed].tolist()):
                for item, place in found[k]:
                    yield p, item, place

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, end) of each item that a text holds, at its first best place."""
        own = [words_of(t) for t in texts]
        get = self.known.get
        numbers = np.array([x for ws in own for x in (0, *[get(w, 0) for w in ws])], np.uint64)
        begins = np.cumsum([0] + [len(ws) + 1 for ws in own]) + 1
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p, item, place in self.hits(numbers):
            doc = int(np.searchsorted(begins, p, "right")) - 1
            near[doc, item].add(p - place - int(begins[doc]))
        for (doc, item), diagonals in sorted(near.items()):
            n, budget = len(self.words[item]), self.budget[item]
            spans: list[list[int]] = []
            for d in sorted(diagonals):
                a, b = max(0, d - budget), min(len(own[doc]), d + n + budget)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            best = None
            for a, b in spans:
                edits, end = search(self.masks[item], n, own[doc][a:b])
                if edits <= budget and (best is None or edits < best[0]):
                    best = (edits, a, a + end)
            if best:
                edits, a, end = best
                backward = {w: int(f"{m:0{n}b}"[::-1], 2) for w, m in self.masks[item].items()}
                _, size = search(backward, n, own[doc][a:end][::-1])
                yield doc, item, edits, end - size, end


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most `most` bytes of text, one item at least."""
    rows, have = [], 0
    for r in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct().toLocalIterator():
        size = len(r["text"].encode())
        if rows and have + size > most:
            yield rows
            rows, have = [], 0
        rows.append((r["id"], r["text"]))
        have += size
    if rows:
        yield rows


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.25, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, text_key, item, edits, item_words, start, end) of each item that a document holds; start and end count the document's words."""
    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kinds = [("edits", T.LongType()), ("item_words", T.LongType()), ("start", T.LongType()), ("end", T.LongType())]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("item", benchmark.schema[item_col].dataType), *[T.StructField(*k) for k in kinds]])
    item_type = schema["item"].dataType
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, rate))
        part = source.mapInArrow(_finder(shared, schema.names, _arrow(item_type)), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _finder(shared, names: list[str], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in released(batches):
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                found = list(items.matches(texts[a:b]))
                if found:
                    doc, item, edits, start, end = zip(*found)
                    take = pa.array([a + d for d in doc])
                    own = [pa.array([items.ids[i] for i in item], item_type), pa.array(edits, pa.int64()), pa.array([len(items.words[i]) for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *own], names=names)

    return run


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item."""
    bad = found.select(F.col("id").alias("bad_id__"), F.col("text_key").alias("bad_key__")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id__"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["bad_key__"]), "left_anti")
