"""LRU page cache over access traces: an auditable event log, and its relational summaries.

A trace is (session, seq, page_id). State is the pages resident in a session, at most `capacity` of them, so a trace of
any length streams through in the order of seq; sessions are dealt over tasks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "session string, event_seq long, event_type string, query_index long, page_id string, page_bytes double, resident_pages_after int, resident_bytes_after double"


#: What else an access may bring along for event_log().
ACCESS = {"timestamp_ns": "long", "query_key": "string", "source_page_id": "string", "load_ms": "double"}

#: (type, page, bytes of the page, resident pages, resident bytes)
Event = tuple[str, str, float, int, float]


class Lru:
    """One session's cache; touch() and prefetch() return events. page_bytes is the size of pages that come without one."""

    def __init__(self, capacity: int, page_bytes: float = 1.0, pages: list[str] | None = None):
        self.capacity, self.page_bytes = capacity, page_bytes
        self.pages: OrderedDict[str, float] = OrderedDict((p, page_bytes) for p in pages or [])

    def _load(self, page: str, size: float | None) -> list[tuple[str, float]]:
        """Pages evicted by loading one. With capacity 0 the page evicts itself, which is not an event."""
        self.pages[page] = self.page_bytes if size is None else size
        out = []
        while len(self.pages) > self.capacity:
            gone = self.pages.popitem(last=False)
            if gone[0] != page:
                out.append(gone)
        return out

    def _events(self, kinds: list[tuple[str, str, float]]) -> list[Event]:
        n, total = len(self.pages), sum(self.pages.values())
        return [(*kind, n, total) for kind in kinds]

    def _loaded(self, kind: str, page: str, size: float | None) -> list[Event]:
        gone = self._load(page, size)
        return self._events([(kind, page, self.page_bytes if size is None else size), *(("eviction", *g) for g in gone)])

    def touch(self, page: str, size: float | None = None) -> list[Event]:
        if page in self.pages:
            self.pages.move_to_end(page)
            return self._events([("cache_hit", page, self.pages[page])])
        return self._loaded("demand_load", page, size)

    def prefetch(self, page: str, size: float | None = None) -> list[Event]:
        """Start, completion and evictions; nothing for a resident page."""
        if page in self.pages:
            return []
        start = self._events([("prefetch_start", page, self.page_bytes if size is None else size)])
        return start + self._loaded("prefetch_complete", page, size)


def simulate(trace: DataFrame, capacity: int, page_bytes: float = 1.0, carried: tuple[str, ...] = ()) -> DataFrame:
    """The event log (EVENTS) of a trace (session, seq, page_id[, action][, page_bytes]); action 'prefetch' loads ahead of
    use.

    query_index is the number of the access in its session, from 0; event_seq counts a session's events from 1. Accesses
    without a page are passed over. A page has the size that the access which loads it states, else page_bytes. Events
    also get the access's columns named in carried.
    """
    if capacity < 0:
        raise ValueError("the capacity must not be negative")
    if "action" not in trace.columns:
        trace = trace.withColumn("action", F.lit("demand"))
    parts = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.col("page_bytes").cast("double") if "page_bytes" in trace.columns else F.lit(None).cast("double")
    rows = trace.where("page_id is not null").select(F.col("session").cast("string").alias("session"), "seq", F.col("page_id").cast("string").alias("page_id"), "action", size.alias("size"), *carried)
    dealt = rows.repartition(parts, "session").sortWithinPartitions("session", "seq")
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, cache, seq, query, started = None, Lru(capacity, page_bytes), 0, -1, False
        for batch in batches:
            out = []
            for name, _, page, action, size, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or name != session:
                    session, cache, seq, query, started = name, Lru(capacity, page_bytes), 0, -1, True
                if action != "prefetch":
                    query += 1
                for kind, target, held, n, total in cache.prefetch(page, size) if action == "prefetch" else cache.touch(page, size):
                    seq += 1
                    out.append((session, seq, kind, max(query, 0), target, held, n, total, *more))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64(), *(batch.schema.field(c).type for c in carried)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in EVENTS.split(", ")] + list(carried))

    return dealt.mapInArrow(run, ", ".join([EVENTS, *(f"`{c}` {types[c]}" for c in carried)]))


def event_log(trace: DataFrame, capacity: int, page_bytes: float = 1.0) -> DataFrame:
    """The full audit log of a trace (as for simulate(), with the columns of ACCESS where they are known): the session and
    the sixteen columns of a log file.

    load_ms is 0 for all but loads. Completed prefetches state what became of them (see prefetch_outcomes); in all other
    events that is null. Columns that the trace lacks are null.
    """
    known = [(F.col(c) if c in trace.columns else F.lit(None)).cast(kind).alias(c) for c, kind in ACCESS.items()]
    events = simulate(trace.select(*(c for c in trace.columns if c not in ACCESS), *known), capacity, page_bytes, tuple(ACCESS))
    all_ = events.join(prefetch_outcomes(events).drop("page_id"), ["session", "event_seq"], "left")
    loads = F.when(F.col("event_type").isin("demand_load", "prefetch_complete"), F.col("load_ms")).otherwise(F.lit(0.0))
    return all_.select(
        "session", "event_seq", "timestamp_ns", "event_type", "query_index", "query_key", "source_page_id", F.col("page_id").alias("target_page_id"), "page_bytes", loads.alias("load_ms"),
        "used_by_future_query", "prefetch_query_index", "use_query_index", "eviction_query_index", "evicted_before_use", "resident_pages_after", "resident_bytes_after",
    )


def peaks(events: DataFrame) -> DataFrame:
    """events with the running maxima peak_pages and peak_bytes."""
    w = Window.partitionBy("session").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({"peak_pages": F.max("resident_pages_after").over(w), "peak_bytes": F.max("resident_bytes_after").over(w)})


def prefetch_outcomes(events: DataFrame) -> DataFrame:
    """prefetch_complete events with what became of them.

    The next hit, eviction or prefetch of the same page decides: an eviction means evicted before use; a hit in a later
    query means used, one in the same query not; neither leaves all null.
    """
    some = events.where(F.col("event_type").isin("cache_hit", "eviction", "prefetch_complete"))
    w = Window.partitionBy("session", "page_id").orderBy("event_seq")
    after = some.withColumns({"next_type": F.lead("event_type").over(w), "next_query": F.lead("query_index").over(w)}).where("event_type = 'prefetch_complete'")
    hit, gone = F.col("next_type") == "cache_hit", F.col("next_type") == "eviction"
    return after.select(
        "session", "event_seq", "page_id", F.col("query_index").alias("prefetch_query_index"),
        F.when(hit, F.col("next_query") > F.col("query_index")).when(gone, F.lit(False)).alias("used_by_future_query"),
        F.when(hit, F.col("next_query")).alias("use_query_index"),
        F.when(gone, F.col("next_query")).alias("eviction_query_index"),
        F.when(hit, F.lit(False)).when(gone, F.lit(True)).alias("evicted_before_use"),
    )


def neighbour_prefetches(trace: DataFrame, neighbours: DataFrame) -> DataFrame:
    """trace with a prefetch of each neighbour page after each demand access; neighbours: (page_id, neighbour_id)."""
    demand = trace.select("session", (F.col("seq") * 16).alias("seq"), "page_id", F.lit("demand").alias("action"))
    order = Window.partitionBy("page_id").orderBy("neighbour_id")
    near = neighbours.withColumn("i", F.row_number().over(order))
    ahead = trace.join(near, "page_id").select("session", (F.col("seq") * 16 + F.col("i")).alias("seq"), F.col("neighbour_id").alias("page_id"), F.lit("prefetch").alias("action"))
    return demand.unionByName(ahead)


def reuse_distances(trace: DataFrame) -> DataFrame:
    """(session, seq, page_id, distance) of a trace (session, seq, page_id): the distinct other pages since the page's
    last access in its session, -1 at the first one.

    An access hits a least-recently-used cache of capacity c exactly if its distance is at least 0 and below c, so one
    pass gives the hits of all capacities. Sessions stream in order; the state is the session's pages by last access.
    Accesses without a page are passed over.
    """
    parts = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = trace.where("page_id is not null").select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.col("page_id").cast("string").alias("page_id"))
    dealt = rows.repartition(parts, "session").sortWithinPartitions("session", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, started, recent = None, False, []  # pages, the latest last
        for batch in batches:
            distances = []
            for name, page in zip(batch.column("session").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                if not started or name != session:
                    session, started, recent = name, True, []
                at = recent.index(page) if page in recent else -1
                distances.append(len(recent) - 1 - at if at >= 0 else -1)
                if at >= 0:
                    del recent[at]
                recent.append(page)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distances, pa.int64())], ["session", "seq", "page_id", "distance"])

    return dealt.mapInArrow(run, "session string, seq long, page_id string, distance long")
