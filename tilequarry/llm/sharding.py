"""Shards by a Feistel permutation of global row numbers, with cycle walking; DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, need, utf8_bytes

#: Modulus of the round function, the Mersenne prime 2**31 - 1: squares of residues fit a long.
PRIME = (1 << 31) - 1
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two constants for each round, from a linear congruence on the seed."""
    keys, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        y = (x * 48271 + 11) % PRIME
        keys.append((x, y))
        x = y
    return keys


def sides(n: int) -> tuple[int, int]:
    """The two digits' ranges: the least square-like box with at least n cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel_numpy(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One pass of the permutation of the whole box, as the column form computes it."""
    a, b = sides(n)
    left, right = x % a, x // a
    for i, (k1, k2) in enumerate(round_keys(seed)):
        t = ((right if i % 2 == 0 else left) + k1) % PRIME
        t = t * t % PRIME
        t = (t + k2) % PRIME
        t = t * t % PRIME
        if i % 2 == 0:
            left = (left + t) % a
        else:
            right = (right + t) % b
    return left + a * right


def longest_walk(n: int, seed: int) -> int:
    """The most passes that any row number needs until its image is below n.

    Only images in the box but not below n are walked further; the box has fewer than sqrt(n) + 1 of them beyond n, so
    following these few gives the exact bound.
    """
    a, b = sides(n)
    at, passes = np.arange(n, a * b, dtype=np.int64), 1
    while len(at):
        at = feistel_numpy(at, n, seed)
        at = at[at >= n]
        passes += 1
        if passes > a * b:
            break
    return passes


def feistel_sql(x: str, n: int, seed: int) -> str:
    """One pass over the box as an expression of fixed size: a fold over the round keys with the two digits as state."""
    a, b = sides(n)
    keys = ", ".join(f"struct({k1}L as k1, {k2}L as k2, {str(i % 2 == 0).lower()} as even)" for i, (k1, k2) in enumerate(round_keys(seed)))

    def mix(source: str) -> str:
        s = f"(({source} + k.k1) % {PRIME}L)"
        t = f"(({s} * {s} + k.k2) % {PRIME}L)"
        return f"(({t} * {t}) % {PRIME}L)"

    step = f"if(k.even, struct((d.l + {mix('d.r')}) % {a}L as l, d.r as r), struct(d.l as l, (d.r + {mix('d.l')}) % {b}L as r))"
    return f"aggregate(array({keys}), struct({x} % {a}L as l, {x} div {a}L as r), (d, k) -> {step}, d -> d.l + d.r * {a}L)"


def position(row_number: str, n: int, seed: int) -> Column:
    """Image of the row number below n: one pass, and further ones while the image is not below n."""
    if n <= 1:
        return F.expr(f"cast({row_number} as long)")
    walk = longest_walk(n, seed) - 1
    first = feistel_sql(row_number, n, seed)
    if not walk:
        return F.expr(first)
    return F.expr(f"aggregate(sequence(1, {walk}), {first}, (p, i) -> if(p < {n}L, p, {feistel_sql('p', n, seed)}))")


def number_rows(df: DataFrame, order: list[str], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """df with dense global row numbers from 0 in the given order, without a sort in one task.

    Rows are dealt by ranges of the order columns (a salt splits runs of equal keys), written once, and counted for
    each range; a range's rows are numbered by themselves and moved up by the counts of the ranges before it. Nulls
    come first; rows equal in all order columns get consecutive numbers in either order.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = materialise(salted.repartitionByRange(partitions, *order, "_salt").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row for each range, as many as there are partitions: small enough for one task and for a broadcast.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_salt")).cast("long")
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_range", "_salt", "_inside", "_before")


def shard_rows(df: DataFrame, order: list[str], shards: int = 16, seed: int = 42) -> DataFrame:
    """df with row_number, shard and slot: a reproducible shuffle of all rows.

    A row's position is the Feistel image of its row number in the given order; shard = position modulo shards and
    slot = position div shards, so the place of any row follows from its number, the count and the seed alone. Shards
    differ by one row at most and slots are gapless from 0. The box of the permutation has fewer than sqrt(n) + 1 cells
    too many; images there are walked on, as often as the longest walk needs.

    Equal rows stay and get places of their own; null order values come first; an empty table gives an empty table;
    columns named row_number, shard or slot are replaced, other columns stay.
    """
    need(df, *order)
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("row_number", "shard", "slot", "_position")
    numbered = number_rows(df, order)
    n = df.count()
    placed = numbered.withColumn("_position", position("row_number", n, seed))
    return placed.withColumns({"shard": F.expr(f"cast(_position % {shards} as int)"), "slot": F.expr(f"_position div {shards}")}).drop("_position")


def digest(docs: DataFrame) -> DataFrame:
    """What sharding needs of a document: id, size (UTF-8 bytes plus 1) and checksum of the text (null: empty)."""
    need(docs, "doc_id", "text")
    return docs.select("doc_id", (utf8_bytes("text") + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Result of the sharding query: the law `rows` holds (counts at most one apart), so grown_shard is null."""
    placed = shard_rows(digest(docs), ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
