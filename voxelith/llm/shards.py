"""Shards by extendible hashing.

A row's hash is the first 60 bits of an MD5 of its id and its text's MD5. The directory starts with one bucket for the empty prefix; a
bucket whose rows have more bytes than the limit is split on its next hash bit, and so are its halves, until every bucket fits or holds one
single hash (one row, or equal rows, which no hash can part; such a shard may be over the limit). Rounds work on the rows of
oversized buckets only and look BITS bits ahead: bytes are summed for each longer prefix, and the splits are read off these sums.

Null ids and texts count as empty ones; a text's bytes are those of its UTF-8. An empty table has no shards.
Very long texts count whole. Other columns stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, saved, text_of

HASH_BITS, BITS = 60, 6


def row_hash(id_col: str, text: Column) -> Column:
    whole = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(value: Column, depth) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(HASH_BITS) - depth if isinstance(depth, Column) else F.lit(HASH_BITS - depth))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """rows: hash, bytes. (depth, prefix, bytes, rows) of each shard."""
    by_hash = saved(rows.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    sums = (F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    over = (F.col("bytes") > limit) & (F.col("low") < F.col("high"))
    root = saved(by_hash.agg(*sums).where("rows is not null").select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "bytes", "rows", "low", "high"))
    out, open_, depth = root.where(~over), root.where(over), 0
    while depth < HASH_BITS and not open_.isEmpty():
        step = min(BITS, HASH_BITS - depth)
        inside = by_hash.withColumn("prefix", _prefix(F.col("hash"), depth)).join(open_.select("prefix"), "prefix", "left_semi")
        fine = saved(inside.groupBy(_prefix(F.col("hash"), depth + step).alias("prefix")).agg(*sums))
        nodes = None
        for d in range(depth + 1, depth + step + 1):
            up = depth + step - d
            level = fine.groupBy(F.shiftrightunsigned("prefix", up).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("depth", F.lit(d))
            nodes = level if nodes is None else nodes.unionByName(level)
        nodes = saved(nodes.withColumn("over", over))
        # a node exists if its parent was split; the parents of the first level are the open buckets
        parents = nodes.where("over").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        below = nodes.where(F.col("depth") > depth + 1).withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").drop("parent")
        real = saved(nodes.where(F.col("depth") == depth + 1).unionByName(below.select(*nodes.columns)))
        out = out.unionByName(real.where("not over").select(*out.columns))
        depth += step
        open_ = real.where((F.col("depth") == depth) & F.col("over"))
    # (with all hash bits used up, one hash is left in each bucket)
    return out.select("depth", "prefix", "bytes", "rows")


def assign(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", bytes_col: str = "n_bytes", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """df (or its columns `keep`) with the shard's hash prefix as a text of bits and the bytes of the row's text; and the directory (shard, depth, prefix, bytes, rows)."""
    own = dropped(df, shard_col, bytes_col)
    names = [c for c in own.columns if keep is None or c in keep]
    text = text_of(own, text_col)
    key, depth, prefix = (free_name(own, x) for x in ("hash__", "depth__", "prefix__"))
    rows = own.select(*names, row_hash(id_col, text).alias(key), F.octet_length(text).cast("long").alias(bytes_col))
    if keep is not None:
        rows = saved(rows)  # narrow, and read more than once
    shards = saved(directory(rows.select(F.col(key).alias("hash"), F.col(bytes_col).alias("bytes")), limit))
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())  # at most HASH_BITS + 1
    named = shards.withColumn(shard_col, bits(F.col("prefix"), F.col("depth")))
    look = named.select(F.col("depth").alias(depth), F.col("prefix").alias(prefix), shard_col)
    if not depths:
        return rows.withColumn(shard_col, F.lit("")).select(*names, shard_col, bytes_col), named
    tried = rows.withColumn(depth, F.explode(F.array(*[F.lit(d) for d in depths])))
    tried = tried.withColumn(prefix, _prefix(F.col(key), F.col(depth)))
    return tried.join(look, [depth, prefix]).select(*names, shard_col, bytes_col), named


def bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def write(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """Writes df as Parquet, one folder for each shard; returns the directory."""
    placed, shards = assign(df, limit, id_col, text_col, shard_col)
    placed.withColumn(shard_col, F.concat(F.lit("b"), shard_col)).repartition(shard_col).write.partitionBy(shard_col).parquet(path)
    return shards
