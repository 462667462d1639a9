"""Language identification by words first, then by shorter and shorter character n-grams.

The model holds, for each language, log relative frequencies of words and of the n-grams of words (with a mark at both ends).
A text's score for a language is the sum over its words: a known word counts by its frequency; an unknown one is covered from
left to right by the longest known n-grams, each step shorter costing a penalty, and what not even one character explains
costs a floor. The prediction is the best language, its score the posterior under equal priors.

Words are runs of letters (Unicode category L) in lower case; longer ones than PIECE are taken in pieces of that length, in learning as in predicting.

The model is fitted on at most about `per_language` labelled rows of each language (chosen by a hash of doc_id and text, so the
choice depends on nothing else) and keeps, of each language, at most `words` words that stand `least` times in them and `grams` n-grams, so its
size is bounded whatever the corpus; every row is predicted from its whole text, however long.

Null texts and texts without letters (empty, or numbers like a half) are `und` with score 0, as is everything when no row is labelled. Ties go to the
language that sorts first. Rows with a null doc_id are not learned from. Repeated rows are predicted alike. Empty tables give empty ones. Columns
named like a result are replaced, others stay, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, free_name
from .tokens import blocks, released

UNKNOWN = "und"
LONGEST = 5
#: Log cost of each step to a shorter n-gram, and of a character that no n-gram covers.
STEP, FLOOR = 0.7, -14.0
CACHE = 50_000
#: Words longer than this (junk, or scripts without spaces) are scored in pieces of this length.
PIECE = 40
_letters = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    out = []
    for w in _letters.findall(text.lower()):
        out += [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
    return out


class Model:
    """Log frequencies by word and by n-gram: a row of a matrix each, a column for each language."""

    def __init__(self, langs: list[str], words: dict[str, dict[str, float]], grams: dict[str, dict[str, float]]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}

        def logs(counts: dict[str, dict[str, float]]) -> np.ndarray:
            out = np.full((len(counts), len(langs)), 0.5)
            for row, by in enumerate(counts.values()):
                for lang, n in by.items():
                    out[row, at[lang]] += n
            return np.log(out / (out.sum(axis=0) + 1))

        self.words = {w: i for i, w in enumerate(words)}
        self.word_logs = logs(words)
        self.grams: dict[str, int] = {}
        parts = []
        for size in range(1, LONGEST + 1):
            own = {g: by for g, by in grams.items() if len(g) == size}
            self.grams |= {g: len(self.grams) + i for i, g in enumerate(own)}
            parts.append(logs(own))
        self.gram_logs = np.concatenate(parts)
        self._start()

    def _start(self) -> None:
        """No unseen words yet; their rows come after those of the known ones."""
        self.rows = dict(self.words)
        self.table = np.concatenate([self.word_logs, np.zeros((CACHE, len(self.langs)))])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._start()

    def unseen(self, w: str) -> np.ndarray:
        marked, rows, i, cost = f"^{w}$", [], 0, 0.0
        while i < len(marked):
            for size in range(min(LONGEST, len(marked) - i), 0, -1):
                row = self.grams.get(marked[i : i + size])
                if row is not None:
                    rows.append(row)
                    cost -= STEP * (LONGEST - size)
                    break
            else:
                cost += FLOOR
            i += size
        return self.gram_logs[rows].sum(axis=0) + cost

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The rows of words' logs in the table; CACHE words at most."""
        found = list(map(self.rows.get, words))
        if None in found:
            new = dict.fromkeys(w for w, r in zip(words, found) if r is None)
            if len(self.rows) + len(new) > len(self.table):
                self.rows = dict(self.words)
                return self.rows_of(words)
            for w in new:
                self.table[len(self.rows)] = self.unseen(w)
                self.rows[w] = len(self.rows)
            found = list(map(self.rows.get, words))
        return np.array(found)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        each = [words_of(t) if t and self.langs else [] for t in texts]
        words = [w for ws in each for w in ws]
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in each])
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(words), CACHE):
            rows, own = self.rows_of(words[a : a + CACHE]), owner[a : a + CACHE]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[heads]] += np.add.reduceat(self.table[rows], heads, axis=0)
        out = []
        for ws, t in zip(each, total):
            if not ws:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(t.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.clip(t - t[best], -700, 0)).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def held_out(id_col: str = "doc_id"):
    """True for the rows that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, per_language: int = 3000, words: int = 20_000, grams: int = 30_000, least: int = 2, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from the labelled rows that are not held out; df keeps text, label and id columns."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    # a handful of rows, one for each language
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {}, {})
    slots = 1 << 30
    bound = F.coalesce(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(slots, math.ceil(slots * per_language / n)))])[F.col("lang")], F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(slots)) < bound)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    # the very words that predictions are made from
    counts = chosen.select("lang", "text").mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    # a word's n-grams count by its kinds, softened, so that unseen words look like them
    def of_size(n: int):
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.array(*[of_size(n) for n in range(1, LONGEST + 1)]))
    gram_counts = counts.select("lang", F.sqrt("n").alias("n"), F.explode(pieces).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def largest(frame: DataFrame, key: str, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
        return frame.select("lang", F.col(key).alias("key"), F.round("n", 3).alias("n"), F.lit(key).alias("kind")).withColumn("place", place).where(F.col("place") <= most)

    counts = counts.persist()
    try:
        best = largest(counts.where(F.col("n") >= least), "word", words).unionByName(largest(gram_counts, "gram", grams))
        tables: dict[str, dict[str, dict[str, float]]] = {"word": {}, "gram": {}}
        # bounded by the parameters, for each language
        for r in best.orderBy("kind", "lang", "place").collect():
            tables[r["kind"]].setdefault(r["key"], {})[r["lang"]] = float(r["n"])
        return Model(sorted(sizes), tables["word"], tables["gram"])
    finally:
        counts.unpersist()


def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def held_out(id_col: str = "doc_id"):
    """True for the rows that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, per_language: int = 3000, words: int = 20_000, grams: int = 30_000, least: int = 2, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from the labelled rows that are not held out; df keeps text, label and id columns."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    # a handful of rows, one for each language
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {}, {})
    slots = 1 << 30
    bound = F.coalesce(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(slots, math.ceil(slots * per_language / n)))])[F.col("lang")], F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(slots)) < bound)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    # the very words that predictions are made from
    counts = chosen.select("lang", "text").mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    # a word's n-grams count by its kinds, softened, so that unseen words look like them
    def of_size(n: int):
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.array(*[of_size(n) for n in range(1, LONGEST + 1)]))
    gram_counts = counts.select("lang", F.sqrt("n").alias("n"), F.explode(pieces).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def largest(frame: DataFrame, key: str, most: int) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = {}
        for lang in sorted(sizes):
            top = frame.where(F.col("lang") == lang).orderBy(F.desc(F.round("n", 3)), key).limit(most)
            for r in top.select(key, F.round("n", 3).alias("n")).collect():
                out.setdefault(r[key], {})[lang] = float(r["n"])
        return out

    counts, gram_counts = counts.persist(), gram_counts.persist()
    try:
        return Model(sorted(sizes), largest(counts.where("n >= 2"), "word", words), largest(gram_counts, "gram", grams))
    finally:
        counts.unpersist()
        gram_counts.unpersist()


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the predicted language and its score; columns of these names are replaced."""
    rest = dropped(df, lang_col, score_col)
    names = [c for c in rest.columns if keep is None or c in keep]
    schema = T.StructType([*[rest.schema[c] for c in names], T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in released(batches):
            texts = batch.column(at).to_pylist()
            for a, b in blocks(texts):
                part = batch.slice(a, b - a)
                found = own.predict_all(texts[a:b])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, lang_col, score_col])

    # the text goes along once
    carried = text_col in names and isinstance(rest.schema[text_col].dataType, T.StringType)
    at = names.index(text_col) if carried else len(names)
    return rest.select(*names, *([] if carried else [rest[text_col].cast("string").alias(free_name(rest, "text__"))])).mapInArrow(run, schema)
