"""LRU page cache over a stream of accesses, with the resident pages as the state of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import EVENTS, Lru

STATE = "pages array<string>, event_seq long, query_index long"


def stream_cache(accesses: DataFrame, capacity: int, page_bytes: float = 1.0) -> DataFrame:
    """The event log (EVENTS) of a streaming trace (session string, seq long, page_id string[, action string]).

    Action 'prefetch' loads ahead of use; operators.cache.neighbour_prefetches() adds such rows to a stream.

    A micro-batch's accesses of a session are taken in the order of seq; a stream must not bring an access after later
    ones of its session were processed. The state holds at most `capacity` pages a session.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, seq, query = state.get if state.exists else ([], 0, -1)
        cache = Lru(capacity, page_bytes, list(pages))
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for page, action in zip(rows["page_id"], rows["action"], strict=True):
            query += action != "prefetch"
            for kind, target, held, n, total in cache.prefetch(page) if action == "prefetch" else cache.touch(page):
                seq += 1
                out.append((key[0], seq, kind, max(query, 0), target, held, n, total))
        state.update((list(cache.pages), seq, query))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in EVENTS.split(", ")])

    action = F.col("action") if "action" in accesses.columns else F.lit("demand")
    grouped = accesses.where("page_id is not null").select("session", "seq", "page_id", action.alias("action")).groupBy("session")
    return grouped.applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
