"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles. Documents with equal sets form a class; only classes are compared. A signature has
POSITIONS values of 16 bits, the low bits of a minimum each, and two signatures' distance is the number of positions at which they
differ. The positions are cut into CHUNKS. Signatures within ALLOWED * CHUNKS + CHUNKS - 1 differ at ALLOWED positions at most in some
chunk (pigeonhole), so they agree on some choice of the chunk's other positions: with an index key for each chunk and choice,
all pairs within the distance share a key. At similarity 0.75 a pair is farther apart with a probability of about 3e-6.

Pairs are not enumerated within a key. First each class is compared with one class of each of its keys, the one that shares the most
keys with others and, of these, has the fewest shingles of its own (of a family of copies, the one that was changed least), and the confirmed links are contracted to components. What
can still be missing are links between components: only in keys whose members are in several components, the members outside the
chosen class's component are compared with the members of other components, once for each chosen class. Two exact bounds rule out nearly all of
these pairs. A class's shingles that no other class concerned has cannot be in any intersection. And both classes of a pair were
compared with the chosen class: what either lacks of it, and what either has beyond it, is carried along as short hashes where it is little. The
chosen class's size less what either lacks, and what both have beyond it, add up to the intersection's size (short hashes
that meet by chance only raise it), so that only pairs that are linked, but for such chances, are made at all. Where more is lacking, the
shares in the chosen class bound the intersection. Pairs that are made pass the bounds on sizes and signatures, then the full sets decide.

Null and empty texts have an empty set and stand alone; very long texts are taken whole; an empty table gives an empty one. Of classes equally
fit to be chosen the one with the least number is. Extra columns are not read, whatever they are called.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from .common import saved
from .tokens import blocks, mixed, odd_numbers, released, word_hashes

POSITIONS, CHUNKS, ALLOWED = 30, 5, 3
WIDTH = POSITIONS // CHUNKS
DISTANCE = CHUNKS * (ALLOWED + 1) - 1
CHOICES = [tuple(c * WIDTH + p for p in own) for c in range(CHUNKS) for own in itertools.combinations(range(WIDTH), WIDTH - ALLOWED)]
_FACTORS = odd_numbers(POSITIONS, 71)
_SEEDS = odd_numbers(POSITIONS, 73)
_STRIDE = 1 << 13
#: Shingles lacking in, or beyond, the chosen class that are carried along; with more, a weaker bound is used.
CARRIED = 128


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    weights = odd_numbers(words, 61)
    for a, b in blocks(texts):
        # bytes.lower() changes A-Z only
        own = [t.encode().lower().split() if t else [] for t in texts[a:b]]
        hashes = word_hashes([w for ws in own for w in ws])
        at = 0
        for ws in own:
            n = len(ws)
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            span = min(words, n)
            sums = np.full(max(1, n - words + 1), np.uint64(span))
            for j in range(span):
                sums = sums + hashes[at + j : at + j + len(sums)] * weights[j]
            at += n
            yield np.unique(mixed(sums))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minimum under each hash function."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _STRIDE):
        part = mixed((shingles[None, i : i + _STRIDE] ^ _SEEDS[:, None]) * _FACTORS[:, None])
        low = np.minimum(low, part.min(axis=1))
    return (low & np.uint64(0xFFFF)).astype("<u2")


def sketches(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_key, n, set_key, sig) of each row; set_key and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            n, keys, sigs = [], [], []
            for s in shingle_sets(batch.column(2).to_pylist(), words):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "text_key", "n", "set_key", "sig"])

    text = F.col(text_col).cast("string")
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return source.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, text_key long, n long, set_key binary, sig binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): an exact 55-bit key for each choice of positions."""
    choices = np.array(CHOICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, POSITIONS).astype(np.int64)
                key = np.broadcast_to(np.arange(len(choices), dtype=np.int64), (len(sig), len(choices)))
                for j in range(choices.shape[1]):
                    key = key << 16 | sig[:, choices[:, j]]
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), len(choices)))], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _near(percent: int):
    """Whether a candidate's sizes and signatures allow a link."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    # two bytes a position
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.substring("sig_a", i * 2 + 1, F.lit(2)) == F.substring("sig_b", i * 2 + 1, F.lit(2))))
    return sizes & (same >= POSITIONS - DISTANCE)


def full_sets(reps: DataFrame, classes: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(rep, set): the sorted shingle hashes, 8 bytes each, made again from one text of each class in reps."""
    wanted = reps.distinct().join(classes.select("rep", "id", "text_key"), "rep")
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & (rows["text_key"] == wanted["text_key"])).select("rep", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "set"])

    return saved(texts.mapInArrow(to_sets, "rep long, set binary").dropDuplicates(["rep"]))


def alone_counts(sets: DataFrame) -> DataFrame:
    """(rep, alone): how many shingles no other of these sets has; sets without such are left out."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for rep, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(x.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rep)), pa.array(own)], names=["rep", "shingle"])

    each = sets.select("rep", "set").mapInArrow(out, "rep long, shingle long")
    once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("rep").alias("rep")).where("sets = 1")
    return once.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))


def _short(own: np.ndarray, other: np.ndarray, count: int) -> np.ndarray | None:
    """32 bits of each shingle of own that other has not; null if they are more than CARRIED, or two have the same 32 bits."""
    if count > CARRIED:
        return None
    found = np.unique(np.setdiff1d(own, other, assume_unique=True).astype(np.uint32).view(np.int32))
    return found if len(found) == count else None


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, near_only: bool = True) -> DataFrame:
    """(a, b, shared, beyond, lacking, linked) of the pairs, or of those that sizes and signatures allow.

    The intersection's size, short hashes of what b has beyond a and of what b lacks of a, and whether 100 * intersection >= percent * union.
    """
    if near_only:
        for side in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        pairs = pairs.where(_near(percent)).select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            shared, beyond, lacking, linked = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([p, q]), kind="stable")
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                shared.append(n)
                beyond.append(_short(q, p, len(q) - n))
                lacking.append(_short(p, q, len(p) - n))
                linked.append(100 * n >= percent * (len(p) + len(q) - n))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (beyond, lacking)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), *lists, pa.array(linked, pa.bool_())], names=["a", "b", "shared", "beyond", "lacking", "linked"])

    full = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    return saved(full.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long, shared long, beyond array<int>, lacking array<int>, linked boolean"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id, text_key, n_shingles, component_id, kept) of each row of df; text_key is xxhash64 of the text.

    component_id is the smallest id that links reach, kept tells the row whose id that is. Null and empty texts have an
    empty set and stand alone; shorter texts than a shingle are one shingle; repeated rows are in one component; a null id
    is never the smallest unless all are null.
    """
    found = saved(sketches(df, id_col, text_col, words))
    classes = found.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_key")).alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("rep"), "set_key", "least", "row.id", "row.text_key", "n", "sig"))
    keys = index_keys(classes)
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    members = saved(keys.join(shared, "key"))
    sets = full_sets(members.select("rep"), classes, df, id_col, text_col, words)
    held = members.groupBy("rep").agg(F.count(F.lit(1)).alias("keys")).join(alone_counts(sets), "rep", "left")
    held = saved(held.join(classes.select("rep", "n"), "rep").select("rep", "keys", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")))
    best = F.max(F.struct("keys", (F.col("s") - F.col("n")).alias("alone"), (-F.col("rep")).alias("low")))
    ranked = members.join(held, "rep").groupBy("key").agg(best.alias("m"))
    members = saved(members.join(ranked.select("key", (-F.col("m.low")).alias("first")), "key"))
    stars = members.where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    compared = verified(stars, classes, sets, percent, near_only=False)
    links = compared.where("linked").select("a", "b")

    of = saved(components(links)) if not links.isEmpty() else None
    if of is None:
        placed = members.withColumn("component", F.col("rep"))
    else:
        placed = members.join(of.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = saved(placed.select("key", "first", "rep", "component"))
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.max(F.when(F.col("rep") == F.col("first"), F.col("component"))).alias("main")).where("p < q").select("key", "main")
    some = placed.join(mixed_keys, "key").select("first", "rep", "component", (F.col("component") != F.col("main")).alias("minor")).distinct()
    # what no partner of any size could make up for is out: intersection <= s, union >= n
    able = some.join(held.where(F.col("s") * 100 >= F.col("n") * percent).select("rep", "n", "s"), "rep")
    with_first = compared.select(F.col("a").alias("first"), F.col("b").alias("rep"), F.col("shared").alias("i"), F.col("beyond").alias("e"), F.col("lacking").alias("m"))
    sizes = classes.select(F.col("rep").alias("first"), F.col("n").alias("n_first"))
    able = saved(able.where("first <> rep").join(with_first, ["first", "rep"]).join(sizes, "first"))
    numbers = ["n", "s", "i", "e", "m"]
    x = able.where("minor").select("first", "n_first", F.col("rep").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"{c}_a") for c in numbers])
    y = able.select("first", F.col("rep").alias("b"), F.col("component").alias("cb"), *[F.col(c).alias(f"{c}_b") for c in numbers], "minor")
    different = (F.col("ca") != F.col("cb")) & (~F.col("minor") | (F.col("a") < F.col("b")))
    enough = lambda most: most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent
    outside = F.least(F.col("s_a") - F.col("i_a"), F.col("s_b") - F.col("i_b"))
    inside = F.least("i_a", "i_b")
    both_beyond = F.when(F.col("e_a").isNull() | F.col("e_b").isNull(), outside).otherwise(F.size(F.array_intersect("e_a", "e_b")))
    both_inside = F.when(F.col("m_a").isNull() | F.col("m_b").isNull(), inside).otherwise(F.col("n_first") - F.size(F.array_union("m_a", "m_b")))
    fits = different & enough(F.least("s_a", "s_b")) & enough(inside + outside) & enough(both_inside + both_beyond)
    # pairs with the chosen class itself were compared in the first round
    rest = x.join(y, "first").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = verified(rest, classes, sets, percent).where("linked").select("a", "b")
    if not more.isEmpty():
        of = saved(components(links.unionByName(more)))
    if of is None:
        named = classes.select("set_key", F.col("least").alias("component_id"))
    else:
        own = classes.join(of.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        least = own.groupBy("component").agg(F.min("least").alias("component_id"))
        named = own.select("set_key", "component").join(least, "component").select("set_key", "component_id")
    out = found.select("id", "text_key", F.col("n").alias("n_shingles"), "set_key").join(saved(named), "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select("id", "text_key", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
