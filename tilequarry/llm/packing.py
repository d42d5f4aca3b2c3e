"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, need

#: Pieces that one task packs together; more pieces make more groups, not larger ones.
GROUP = 4096
#: Copies of one row that are numbered at a time.
RUN = 4096


class BestFit:
    """Bins ordered by what is left in them; each carries bitmaps of the sources and of the duplicate clusters in it.

    A piece goes to the tightest bin that has room and no conflict: the search starts at the first bin with enough left
    and goes to the successor until one is compatible. Two pieces conflict if they are of one cluster, or of one source
    that already fills its share of the bin.
    """

    def __init__(self, capacity: int, source_share: float):
        self.capacity, self.most = capacity, max(1, int(capacity * source_share))
        self.order: list[tuple[int, int]] = []  # (left, bin)
        self.full: list[int] = []  # bitmap of the sources that have filled their share
        self.clusters: list[int] = []  # bitmap of clusters
        self.by_source: list[dict[int, int]] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        order, s, c = self.order, 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order):
            left, b = order[at]
            if not self.full[b] & s and not self.clusters[b] & c and self.by_source[b].get(source, 0) + size <= max(self.most, size if not self.by_source[b] else 0):
                del order[at]
                break
            at += 1
        else:
            left, b = self.capacity, len(self.full)
            self.full.append(0)
            self.clusters.append(0)
            self.by_source.append({})
        used = self.by_source[b]
        used[source] = used.get(source, 0) + size
        if used[source] >= self.most:
            self.full[b] |= s
        self.clusters[b] |= c
        insort(order, (left - size, b))  # a full bin can still take pieces of no size
        return b


def pack_group(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, source_share: float) -> list[int]:
    """Bin numbers from 0, largest pieces first; the order of equal sizes is that of the lists."""
    fit = BestFit(capacity, source_share)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = fit.place(sizes[i], sources[i], clusters[i])
    return bins


def word_tokens(text_col: str = "text") -> Column:
    """Words of the text plus one end mark; what packing takes as a document's size unless a size column is given."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), WORD_GAP), lambda w: w != ""))
    return (words + 1).cast("long")


def text_cluster(text_col: str = "text") -> Column:
    """Documents equal but for case and white space are one cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+", " ")))


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster", capacity: int = 2048, source_share: float = 0.75, group: int = GROUP) -> DataFrame:
    """(id, piece, n_pieces, n_tokens, bin_id, bin_offset): every token of every item in a bin.

    An item larger than the capacity is cut: full pieces are bins of their own, the rest is packed. A piece goes to the
    tightest bin with room where its source stays within source_share of the capacity (a lone piece may exceed it) and
    no piece of its duplicate cluster lies. Items are dealt to groups of about `group` by a hash of the id, size and
    cluster, and bins hold one group, so a task's work is bounded whatever the number of items; a hot source or cluster
    spreads over all groups. bin_id is unique over all groups; bin_offset is the first token's place in the bin.

    A null size counts as 0, a size of 0 or less takes no room but gets a place; null sources and null clusters are
    one source, and no cluster at all; a null id stays; repeated rows are packed each (equal ones are told apart by a
    copy number); an empty table gives an empty table. Other columns are not returned.
    """
    need(items, id_col, size_col, source_col, cluster_col)
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    rows = items.select(F.col(id_col).alias("_id"), size.alias("_size"), F.col(source_col).cast("string").alias("_source"), F.col(cluster_col).cast("string").alias("_cluster"))
    groups = max(1, -(-rows.count() // group))
    # Equal rows are told apart by a copy number, so the groups depend on the rows alone and a row that repeats without
    # end spreads over all of them.
    each = rows.groupBy("_id", "_size", "_source", "_cluster").agg(F.count("*").alias("_n"))
    each = each.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_n - 1) div {RUN})")))
    each = each.withColumn("_copy", F.explode(F.expr(f"sequence(_run * {RUN}L, least((_run + 1) * {RUN}L, _n) - 1)"))).drop("_n", "_run")
    dealt = each.withColumn("_group", F.pmod(F.xxhash64("_id", "_size", "_source", "_cluster", "_copy"), F.lit(groups)))
    id_type = dict(rows.dtypes)["_id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("_size", "descending"), *((c, "ascending") for c in ("_id", "_cluster", "_source", "_copy"))]))
        sizes = table["_size"].to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        full = np.where((rest == 0) & (full > 0), full - 1, full)
        rest = sizes - full * capacity
        sources, _ = pd.factorize(table["_source"].to_pandas().fillna("\0"))
        clusters = [f"\0{i}" if c is None else c for i, c in enumerate(table["_cluster"].to_pylist())]
        clusters, _ = pd.factorize(np.array(clusters, dtype=object))
        bins = pack_group(rest.tolist(), sources.tolist(), clusters.tolist(), capacity, source_share)
        out: list[tuple[int, int, int, int, int]] = []
        used: dict[int, int] = {}
        next_bin = max(bins, default=-1) + 1
        order = sorted(range(len(bins)), key=lambda i: (bins[i], -rest[i], i))
        for i in order:
            for p in range(int(full[i])):
                out.append((i, p, capacity, next_bin, 0))
                next_bin += 1
            out.append((i, int(full[i]), int(rest[i]), bins[i], used.get(bins[i], 0)))
            used[bins[i]] = used.get(bins[i], 0) + int(rest[i])
        at, piece, tokens, bin_no, offset = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
        g = table["_group"][0].as_py() if len(table) else 0
        # Ids never leave Arrow, so large ones stay exact beside nulls.
        columns = [table["_id"].take(pa.array(at)), piece.astype(np.int32), (full[at] + 1).astype(np.int32), tokens, bin_no * groups + g, offset]
        return pa.table(columns, [id_col, "piece", "n_pieces", "n_tokens", "bin_id", "bin_offset"])

    return dealt.groupBy("_group").applyInArrow(run, f"`{id_col}` {id_type}, piece int, n_pieces int, n_tokens long, bin_id long, bin_offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """Packing of documents by their words, with exact copies as duplicate clusters."""
    need(docs, "doc_id", "text", "source")
    return pack(docs.select("doc_id", "source", word_tokens().alias("n_tokens"), text_cluster().alias("cluster")), capacity=capacity)
