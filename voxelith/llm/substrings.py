"""Removal of word sequences that stand elsewhere too, found by recompression.

Words get 64-bit names. In rounds, maximal runs of equal names get the name of (name, length), and then, with the alphabet split into two
halves by a hash that changes from round to round, each pair of neighbours from the first and the second half gets the name of
the pair. Names are hashes of what they stand for, so they are the same wherever and whenever a text is read: equal word
sequences get equal symbols, but for what depends on words outside of them. Each symbol therefore keeps its context, the
stretch of words that determines it.

A window is `window` consecutive words. Its anchor is, among the symbols of the highest round that has one whose context lies within
the window, the one with the least name. Equal windows have equal anchors at equal places, so a window can only be repeated if
its anchor (name and context) is. Consecutive windows with one anchor are an instance. Instances are counted by anchor:
what is alone is unique; where all instances of an anchor are the same word sequence, all their windows are repeated; the windows of the
other instances are counted one by one, each different instance once.

Null and empty texts have no words, texts of less than `window` words no windows; very long ones are taken whole; empty tables give empty ones. Extra columns
stay, whatever they are called, but those named like a result are replaced. Documents are rows with equal id and text: repeated rows count as places of their own, and lose the same words. Words are
compared by 64-bit hashes and windows by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, free_name, saved
from .tokens import blocks, mixed, odd_numbers, released, split, word_hashes

ROUNDS = 3
_K = odd_numbers(8, 17)
_SALT = odd_numbers(64, 19)


class Stretch:
    """Words of some documents, one after another, with prefix sums for the hash of any stretch of them."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray):
        self.names = names
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        n = len(names)
        self.sums = []
        for base, own in ((_K[0], names), (_K[1], mixed(names ^ _K[2]))):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
            self.sums.append((np.concatenate([[np.uint64(0)], np.cumsum(own * power[:n], dtype=np.uint64)]), back))

    def hashed(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        sums, back = self.sums[which]
        return mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))

    def starts(self, window: int) -> np.ndarray:
        """Where windows start."""
        at = np.arange(len(self.names))
        return at[at + window <= self.ends[self.doc]]


class Symbols:
    """The symbols of one round: names, first words, and contexts (a context that reaches a document's edge goes one word beyond it)."""

    def __init__(self, name, start, low, high, doc):
        self.name, self.start, self.low, self.high, self.doc = name, start, low, high, doc

    @staticmethod
    def words(s: Stretch) -> Symbols:
        at = np.arange(len(s.names))
        return Symbols(s.names, at, at, at + 1, s.doc)

    def _beside(self, s: Stretch) -> tuple[np.ndarray, np.ndarray]:
        """The low end of the symbol before, the high end of the symbol after; one beyond the edge where there is none."""
        before, after = s.begins[self.doc] - 1, s.ends[self.doc] + 1
        same = self.doc[1:] == self.doc[:-1]
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return before, after

    def runs(self, s: Stretch) -> Symbols:
        equal = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1])
        heads = np.flatnonzero(np.concatenate([[True], ~equal]))
        length = np.diff(np.append(heads, len(self.name)))
        name = self.name[heads]
        long = length > 1
        name[long] = mixed(name[long] * _K[3] + length[long].astype(np.uint64))
        # that a run goes no farther shows in the symbols beside it
        before, after = self._beside(s)
        return Symbols(name, self.start[heads], before[heads], after[heads + length - 1], self.doc[heads])

    def pairs(self, s: Stretch, salt: np.uint64) -> Symbols:
        first = (mixed(self.name ^ salt) & np.uint64(1)) == 0
        same = self.doc[1:] == self.doc[:-1]
        joined = np.zeros(len(self.name), bool)
        joined[:-1] = first[:-1] & ~first[1:] & same
        second = np.concatenate([[False], joined[:-1]])
        before, after = self._beside(s)
        name, low, high = self.name.copy(), self.low.copy(), self.high.copy()
        at = np.flatnonzero(joined)
        name[at] = mixed(self.name[at] * _K[4] + self.name[at + 1] * _K[5] + salt)
        high[at] = self.high[at + 1]
        # a symbol stays alone because of what follows, or of what precedes
        alone = first & ~joined
        high[alone] = after[alone]
        alone = ~first & ~second
        low[alone] = before[alone]
        kept = ~second
        return Symbols(name[kept], self.start[kept], low[kept], high[kept], self.doc[kept])


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first least value in each range [a, b), none of them empty."""
    width = int((b - a).max())
    tables = [np.arange(len(values))]
    size = 1
    while 2 * size <= width:
        x, y = tables[-1][:-size], tables[-1][size:]
        tables.append(np.where(values[y] < values[x], y, x))
        size *= 2
    out = np.empty(len(a), np.int64)
    k = np.frexp(b - a)[1] - 1
    for i, t in enumerate(tables):
        at = np.flatnonzero(k == i)
        x, y = t[a[at]], t[b[at] - (1 << i)]
        out[at] = np.where(values[y] < values[x], y, x)
    return out


def instances(s: Stretch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash of all words, first window and number of windows of each instance."""
    at = s.starts(window)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    rounds = [Symbols.words(s)]
    for r in range(ROUNDS):
        rounds.append(rounds[-1].runs(s).pairs(s, _SALT[r]))
    place = np.full(len(at), -1)  # number of the anchor, counted through all rounds
    open_ = np.arange(len(at))
    base, anchor = 0, np.zeros(len(at), np.uint64)
    for r in range(ROUNDS, -1, -1):
        y = rounds[r]
        a = np.searchsorted(y.low, at[open_], "left")
        b = np.searchsorted(y.high, at[open_] + window, "right")
        has = np.flatnonzero(a < b)
        if len(has):
            j = _least(y.name, a[has], b[has])
            place[open_[has]] = base + j
            where = s.hashed(0, y.low[j], y.high[j])
            anchor[open_[has]] = mixed(where + y.name[j] * _K[6] + (y.start[j] - y.low[j]).astype(np.uint64) * _K[7] + np.uint64(r))
            open_ = np.delete(open_, has)
        base += len(y.name)
        if not len(open_):
            break
    change = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(np.concatenate([[True], change]))
    count = np.diff(np.append(heads, len(at)))
    first = at[heads]
    return anchor[heads], s.hashed(1, first, first + count - 1 + window), first, count


def _stretches(texts: list[str | None]) -> Iterator[tuple[int, Stretch]]:
    for a, b in blocks(texts):
        own = [split(t) for t in texts[a:b]]
        yield a, Stretch(word_hashes([w for ws in own for w in ws]), np.array([len(ws) for ws in own], np.int64))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _instances(rows: DataFrame, window: int) -> DataFrame:
    schema = T.StructType([rows.schema["id"], rows.schema["text_key"], *[T.StructField(n, t) for n, t in (("anchor", T.LongType()), ("span", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for a, s in _stretches(batch.column(2).to_pylist()):
                anchor, span, first, count = instances(s, window)
                if len(first):
                    doc = s.doc[first]
                    take = pa.array(a + doc)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array((first - s.begins[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """rows: id, text_key, text, places (array of start, n, weight). A row for each window: id, text_key, pos, weight and two hashes."""
    schema = T.StructType([rows.schema["id"], rows.schema["text_key"], *[T.StructField(n, t) for n, t in (("pos", T.IntegerType()), ("weight", T.IntegerType()), ("wa", T.LongType()), ("wb", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            places = batch.column(3)
            for a, s in _stretches(batch.column(2).to_pylist()):
                pos, weight, doc = [], [], []
                for d in range(len(s.begins)):
                    for p in places[a + d].as_py():
                        pos.append(np.arange(p["start"], p["start"] + p["n"]))
                        weight.append(np.full(p["n"], p["weight"]))
                        doc.append(np.full(p["n"], d))
                pos, weight, doc = (np.concatenate(x) for x in (pos, weight, doc))
                at = s.begins[doc] + pos
                take = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(weight.astype(np.int32)), pa.array(s.hashed(0, at, at + window).view(np.int64)), pa.array(s.hashed(1, at, at + window).view(np.int64))], names=schema.names)

    return rows.select("id", "text_key", "text", "places").mapInArrow(run, schema)


def _with(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """rows joined with lists by id and text_key, nulls included."""
    right = lists.select(F.col("id").alias("other_id"), F.col("text_key").alias("other_key"), *[c for c in lists.columns if c not in ("id", "text_key")])
    return rows.join(right, rows["id"].eqNullSafe(right["other_id"]) & (rows["text_key"] == right["other_key"]), how).drop("other_id", "other_key")


def repeated(df: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, start, n): n consecutive windows from start on that all stand elsewhere too."""
    rows = _rows(df, id_col, text_col)
    found = saved(_instances(rows, window))
    by_anchor = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"), F.min("span").alias("low"), F.max("span").alias("high")).where("all > 1")
    # written first, so that a hot anchor's part of the join can be split
    by_anchor = saved(by_anchor.select("anchor", (F.col("low") == F.col("high")).alias("alike")))
    shared = saved(found.join(by_anchor, "anchor"))
    place = F.struct("id", "text_key", "start", "n")
    kinds = saved(shared.where("not alike").groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("all"), F.min(place).alias("place")))
    several = kinds.where("all > 1").select("anchor", "span")
    alike = shared.where("alike").unionByName(shared.where("not alike").join(several, ["anchor", "span"], "left_semi").select(*shared.columns))
    # one of each kind of instance; what stands twice weighs enough by itself
    each = kinds.select("place.*", F.least(F.col("all"), F.lit(2)).cast("int").alias("weight"))
    listed = each.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "n", "weight")).alias("places"))
    # rows equal in id and text are one here; their instances were counted apart
    texts = _with(rows, listed, "inner").dropDuplicates(["id", "text_key"]) if _has_repeats(found) else _with(rows, listed, "inner")
    singles = saved(_windows(texts, window))
    twice = singles.groupBy("wa", "wb").agg(F.sum("weight").alias("all")).where("all > 1").select("wa", "wb")
    more = singles.where("weight = 1").join(twice, ["wa", "wb"], "left_semi").select("id", "text_key", F.col("pos").alias("start"), F.lit(1).alias("n"))
    return alike.select("id", "text_key", "start", "n").unionByName(more)


def _has_repeats(found: DataFrame) -> bool:
    """Whether two rows are equal in id and text (then each has its own instance at each place)."""
    return not found.where("start = 0").groupBy("id", "text_key").count().where("count > 1").isEmpty()


def dedup(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", words_col: str = "n_words", removed_col: str = "n_removed", spans_col: str = "removed", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the text that is left, words joined by one space, the number of words before and of those removed, and the removed spans of words.

    Columns of these names are replaced; a null text becomes empty.
    """
    own = dropped(df, words_col, removed_col, spans_col)
    names = [c for c in own.columns if c != text_col and (keep is None or c in keep)]
    lists = repeated(own, window, id_col, text_col).groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    key, text, places, id_, other_id, other_key = (free_name(own, x) for x in ("text_key__", "text__", "places__", "id__", "other_id__", "other_key__"))
    lists = lists.select(F.col("id").alias(other_id), F.col("text_key").alias(other_key), F.col("places").alias(places))
    left = own.select(*names, F.col(id_col).alias(id_), F.xxhash64(F.col(text_col).cast("string")).alias(key), F.col(text_col).cast("string").alias(text))
    both = left.join(lists, F.col(id_).eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key)), "left").select(*names, text, places)
    spans = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType([*[own.schema[c] for c in names], T.StructField(text_col, T.StringType()), T.StructField(words_col, T.LongType()), T.StructField(removed_col, T.LongType()), T.StructField(spans_col, spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts, found = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1)
            for a, b in blocks(texts):
                kept, n, gone, cuts = [], [], [], []
                for t, p in zip(texts[a:b], found.slice(a, b - a)):
                    words = split(t)
                    edge = np.zeros(len(words) + 1, np.int32)
                    if p.is_valid:
                        start, count = p.values.field("start").to_numpy(), p.values.field("n").to_numpy()
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + count - 1 + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                    kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c]).decode() if len(turns) else b" ".join(words).decode())
                    n.append(len(words))
                    gone.append(int(covered.sum()))
                    cuts.append(turns.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(names)]), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.list_(pa.list_(pa.int32())))], names=schema.names)

    return both.mapInArrow(run, schema)
