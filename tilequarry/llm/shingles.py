"""Near-duplicate documents by an exact Jaccard join of word n-grams with token-combination prefixes.

Tokens (hashed n-grams) have one global order: by corpus frequency, then by hash. Two sets that reach the threshold miss
at most e = n - ceil(t * n) tokens of either side, so they share tokens near the start of that order. Rare tokens are
indexed one by one. Frequent tokens are indexed by combinations of two, neighbours in that order, and the prefix is
extended until the sets must have such a pair in common. Documents that have nothing to do with each other share some
frequent tokens, but hardly ever two that are neighbours in both, so lists hold little else than copies at any size of
the corpus. Candidates are verified on the whole sets.

Groups never become all pairs: each index list first links its members to a pivot of similar size, then each member to
the closest one of another component; only members that the verified links leave in different components, and whose
parity bitmaps allow a link, are paired in full after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, need

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_K = np.uint64(0x9E3779B97F4A7C15)
#: Counters of the frequency table, and rows in which it is gathered; both fixed, so the table never grows.
COUNTERS, CHUNKS = 1 << 20, 64
#: A token is rare if its counter shows no more sets than this. Counters never show too few; as they fill up with the
#: corpus, more tokens count as frequent.
RARE = 4
BITS = 1 << 24
#: Bits of a set's parity bitmap.
SKETCH = 512
#: Members of one pivot that one task verifies.
FAN = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; with fewer words one for all of them, without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(w))
    h = w[: len(w) - width + 1].copy()
    for i in range(1, width):
        h = h * _K + w[i : len(w) - width + 1 + i]
    return np.unique(_mix(h + np.uint64(width * 0x632BE59BD9B4E019 % (1 << 64))))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def allowed(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked set can miss."""
    return n - -(-percent * n // 100)


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent: int, percent: int) -> np.ndarray:
    """Index keys of one set; counts are the frequencies of its tokens, above `frequent` they are frequent.

    Sets that only an equal set can be linked with have none. Let a linked set lack a tokens of this one and have b of
    its own. With r rare tokens, none of them shared, a - r frequent ones are missing; a missing one breaks two pairs of
    neighbours, one of the other set's own breaks one, so of the pairs at most 2 (a - r) + b are broken, and 2 a + b is
    at most 2 (1 - t) n. One pair more than that is indexed. Below t = 0.8 short sets may have too few pairs, so all
    tokens are indexed one by one there.
    """
    n = len(tokens)
    largest = 100 * n // percent
    if allowed(largest, percent) == 0 and largest == n:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    want = allowed(n, percent) + 1
    rare = int(np.searchsorted(counts, frequent, side="right")) if percent >= 80 else n
    if rare >= want:
        return tokens[:want]
    pairs = 2 * (100 - percent) * n // 100 - 2 * rare + 1
    rest = tokens[rare : rare + pairs + 1]
    return np.concatenate([tokens[:rare], _mix(rest[:-1] * _K + rest[1:] + np.uint64(1))])


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    """One row a document (id, size and digest of its set, hash of its text) and, with chunk >= 0, each task's frequency
    counters."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_shingles", "d1", "d2", "xh", "chunk", "tally"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, id_type = np.zeros(COUNTERS, np.uint32), None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            rows = []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), n)
                np.add.at(total, (s & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
                rows.append((len(s), *digest(s)))
            size, d1, d2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), batch.column("xh"), pa.array([-1] * len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names)
        if id_type is not None and total.any():
            parts = [zstandard.ZstdCompressor(1).compress(p.tobytes()) for p in np.split(total, CHUNKS)]
            zero = pa.array([0] * CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, id_type), zero, zero, zero, zero, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("xh"))
    return given.mapInArrow(run, f"doc_id {kind}, n_shingles long, d1 long, d2 long, xh long, chunk int, tally binary")


def _frequencies(profiles: DataFrame) -> np.ndarray:
    """The corpus frequency table, of COUNTERS entries, summed over all tasks."""
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // CHUNKS, np.uint64)
        for t in pdf["tally"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(t), np.uint32)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "tally": [total.tobytes()]})

    # Partial sums first: each of 16 groups a chunk adds up its share of the tasks.
    some = profiles.where("chunk >= 0").select("chunk", "tally")
    dealt = some.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    wide = dealt.groupBy("chunk", "_s").applyInPandas(add, "chunk int, tally binary")
    out = np.zeros(COUNTERS, np.uint64)
    for r in wide.toLocalIterator():
        out.reshape(CHUNKS, -1)[r["chunk"]] += np.frombuffer(r["tally"], np.uint64)
    return out


def _index(docs: DataFrame, n: int, percent: int, table: np.ndarray) -> DataFrame:
    """(sig, d1, d2, n): index keys of each set; copies within one task give one. The last 16 bits of a key are replaced
    by the set's size on a logarithmic scale, so one long sorts the entries by list and size."""
    sent = docs.sparkSession.sparkContext.broadcast(table.astype(np.uint32 if table.max() < 2**32 else np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        for batch in batches:
            sigs, d1s, d2s, ns = [], [], [], []

            def flush(sigs=sigs, d1s=d1s, d2s=d2s, ns=ns) -> pa.RecordBatch:
                each = [len(s) for s in sigs]
                out = [np.concatenate(sigs).view(np.int64), np.repeat(np.array(d1s, np.int64), each), np.repeat(np.array(d2s, np.int64), each), np.repeat(np.array(ns, np.int32), each)]
                for x in (sigs, d1s, d2s, ns):
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["sig", "d1", "d2", "n"])

            held = 0
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), n)
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                keys = signatures(s, counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], RARE, percent)
                if len(keys):
                    sigs.append((keys & ~np.uint64(0xFFFF)) | np.uint64(min(0xFFFF, int(math.log2(len(s)) * 2048))))
                    d1s.append(d[0])
                    d2s.append(d[1])
                    ns.append(len(s))
                    held += len(keys)
                if held > 100_000:
                    yield flush()
                    held = 0
            if sigs:
                yield flush()

    return docs.select("text").mapInArrow(run, "sig long, d1 long, d2 long, n int")


def _lists(index: DataFrame, percent: int) -> DataFrame:
    """(sig, d1, d2, n, p1, p2, many): entries of lists with two sets or more; p1, p2: the pivot to be compared first, if
    any; many: whether the list has more than two sets, so that other pairs than those with pivots are left.

    Entries come sorted by list and size and stream through; a pivot holds while the entries' sizes can be linked.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["sig", "d1", "d2", "n", "p1", "p2", "many"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the list's first entries, until there are three
        last = pivot = at = None  # the list, its pivot (digest and size), the key
        many, here, out = False, set(), []

        def told() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return done

        for batch in batches:
            key, d1, d2, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sig = key >> 16
            m = len(sig)
            if not m:
                continue
            # Entries alone in their list are passed over without a look.
            same = np.zeros(m + 1, bool)
            same[1:m] = sig[1:] == sig[:-1]
            same[0] = last is not None and last == sig[0]
            near = same[:m] | same[1:]
            near[-1] = True
            for i in np.flatnonzero(near).tolist():
                row = (int(sig[i]), int(d1[i]), int(d2[i]), int(n[i]))
                if key[i] != at or len(here) > 100_000:  # what is forgotten may be told twice
                    at, here = key[i], set()
                if row[0] != last:
                    if len(held) == 2:
                        out.extend((*h, False) for h in held)
                    last, pivot, many, held = row[0], row[1:], False, [(*row, None, None)]
                    here.add(row[1:3])
                    continue
                if row[1:3] in here:
                    continue
                here.add(row[1:3])
                if pivot[2] * 100 >= percent * row[3]:
                    entry = (*row, *pivot[:2])
                else:
                    entry, pivot = (*row, None, None), row[1:]
                if many:
                    out.append((*entry, True))
                    continue
                held.append(entry)
                if len(held) == 3:
                    out.extend((*h, True) for h in held)
                    many, held = True, []
            if out:
                yield told()
        if len(held) == 2:
            out.extend((*h, False) for h in held)
            yield told()

    dealt = index.repartition(parts, F.shiftright("sig", 16)).sortWithinPartitions("sig")
    return dealt.mapInArrow(run, "sig long, d1 long, d2 long, n int, p1 long, p2 long, many boolean")


def sketch(tokens: np.ndarray) -> bytes:
    """Parity bitmap of a set: two sets' bitmaps differ in no more places than the sets have tokens of their own."""
    return np.packbits(np.bincount((tokens >> np.uint64(20)) & np.uint64(SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(xh, text) of the documents whose text hash is in wanted, and perhaps of some others: a bitmap of fixed size is
    held against every text, so most others go no further."""
    bits = wanted.selectExpr(f"shiftright(pmod(xh, {BITS}L), 5) as at", "shiftleft(1L, cast(pmod(xh, 32L) as int)) as b")
    words = bits.groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(BITS >> 5, np.uint32)
    bitmap[words["at"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = sent.value, set()
        for batch in batches:
            xh = batch.column("xh").to_numpy()
            at = xh & (BITS - 1)
            keep = (marks[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            for i in np.flatnonzero(keep).tolist():
                if int(xh[i]) in seen:
                    keep[i] = False
                seen.add(int(xh[i]))
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("xh"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "xh long, text string")


def _sketches(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(d1, d2, n, sketch) of the sets in wanted (d1, d2, xh); the texts stay where they are."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), n) for t in batch.column("text")]
            ids = [digest(s) for s in sets]
            columns = [pa.array([d[0] for d in ids], pa.int64()), pa.array([d[1] for d in ids], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "n", "sketch"])

    found = _marked(docs, wanted).mapInArrow(drawn, "d1 long, d2 long, n int, sketch binary")
    return found.groupBy("d1", "d2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(wanted.select("d1", "d2"), ["d1", "d2"], "left_semi")


def _plausible(edges: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of edges (x1, x2, y1, y2) whose bitmaps allow a link."""
    left = sketches.select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), F.col("n").alias("xn"), F.col("sketch").alias("xs"))
    right = sketches.select(F.col("d1").alias("y1"), F.col("d2").alias("y2"), F.col("n").alias("yn"), F.col("sketch").alias("ys"))
    both = edges.join(left, ["x1", "x2"]).join(right, ["y1", "y2"]).select("x1", "x2", "y1", "y2", "xn", "yn", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, xs, ys = (batch.column(i).to_pylist() for i in range(4, 8))
            apart = [(int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count() for x, y in zip(xs, ys, strict=True)]
            keep = [d * (100 + percent) <= (i + j) * (100 - percent) for d, i, j in zip(apart, a, b, strict=True)]
            yield batch.select(["x1", "x2", "y1", "y2"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "x1 long, x2 long, y1 long, y2 long")


def _verify(edges: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of edges (x1, x2, y1, y2) whose sets are linked; sets: (d1, d2, xh). A pivot y of many members is spread
    over several tasks."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.select(F.col("x1").alias("d1"), F.col("x2").alias("d2")).unionByName(edges.select(F.col("y1").alias("d1"), F.col("y2").alias("d2"))).distinct()
    wanted = materialise(ends.join(sets, ["d1", "d2"]).select("d1", "d2", "xh"), "wanted")
    texts = materialise(_marked(docs, wanted).join(wanted, "xh").groupBy("d1", "d2").agg(F.first("text").alias("text")), "texts")
    fans = edges.groupBy("y1", "y2").agg(F.count("*").alias("_n"))
    fans = fans.select("y1", "y2", F.ceil(F.col("_n") / F.lit(float(FAN))).cast("int").alias("_fan"))
    left = texts.select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), "text")
    right = texts.select(F.col("d1").alias("y1"), F.col("d2").alias("y2"), "text")
    members = edges.join(fans, ["y1", "y2"]).join(left, ["x1", "x2"]).select("y1", "y2", F.pmod(F.xxhash64("x1", "x2"), F.col("_fan")).cast("int").alias("s"), F.lit(1).alias("member"), "x1", "x2", "text")
    pivots = fans.join(right, ["y1", "y2"]).select("y1", "y2", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)).alias("s"), F.lit(0).alias("member"), F.col("y1").alias("x1"), F.col("y2").alias("x2"), "text")
    dealt = members.unionByName(pivots).repartition(parts, "y1", "y2", "s").sortWithinPartitions("y1", "y2", "s", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: np.ndarray | None = None
        for batch in batches:
            out = []
            for y1, y2, _, member, x1, x2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = shingle_set(text, n)
                if not member:
                    pivot = mine
                elif linked(len(np.intersect1d(mine, pivot, assume_unique=True)), len(mine), len(pivot), percent):
                    out.append((x1, x2, y1, y2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["x1", "x2", "y1", "y2"])

    return dealt.mapInArrow(run, "x1 long, x2 long, y1 long, y2 long")


def components(edges: DataFrame) -> DataFrame:
    """(d1, d2, c1, c2): the least node of each node's component, for all nodes of the edges (x1, x2, y1, y2).

    Labels start as the nodes themselves; in each round a node takes the least label around it and then its label's
    label, until nothing changes. Labels are written after each round.
    """
    x, y = F.struct(F.col("x1").alias("a"), F.col("x2").alias("b")), F.struct(F.col("y1").alias("a"), F.col("y2").alias("b"))
    both = materialise(edges.select(x.alias("u"), y.alias("v")).unionByName(edges.select(y.alias("u"), x.alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("c")), "labels")
    while True:
        around = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        near = labels.join(around, "u").select("u", "c", F.least("c", "m").alias("m"))
        jump = near.join(labels.select(F.col("u").alias("m"), F.col("c").alias("j")), "m").select("u", "c", F.least("m", "j").alias("new"))
        after = materialise(jump, "labels")
        changed = after.where(F.col("c") != F.col("new")).limit(1).count()
        discard(labels)
        labels = after.select("u", F.col("new").alias("c"))
        if not changed:
            return labels.select(F.col("u.a").alias("d1"), F.col("u.b").alias("d2"), F.col("c.a").alias("c1"), F.col("c.b").alias("c2"))


class _Window:
    """Entries of one list, in the order of size, with the first that a set of the current size can be linked with."""

    def __init__(self) -> None:
        self.n: list[int] = []
        self.who: list[tuple[int, int]] = []
        self.comp: list[tuple[int, int]] = []
        self.bits: list[int] = []
        self.rows = np.zeros((16, SKETCH // 64), np.uint64)
        self.start = 0

    def add(self, n: int, who: tuple[int, int], comp: tuple[int, int], bits: bytes) -> None:
        if len(self.n) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(self.n)] = np.frombuffer(bits, np.uint64)
        self.n.append(n)
        self.who.append(who)
        self.comp.append(comp)
        self.bits.append(int.from_bytes(bits, "little"))

    def near(self, n: int, comp: tuple[int, int], bits: bytes, percent: int) -> list[tuple[int, int]]:
        """(difference, position) of entries of other components that size and bitmap allow."""
        while self.start < len(self.n) and self.n[self.start] * 100 < percent * n:
            self.start += 1
        at = range(self.start, len(self.n))
        if len(at) > 24:
            apart = np.bitwise_count(self.rows[self.start : len(self.n)] ^ np.frombuffer(bits, np.uint64)).sum(axis=1, dtype=np.int64)
            most = (np.array(self.n[self.start :]) + n) * (100 - percent) // (100 + percent)
            found = [(int(apart[i]), i + self.start) for i in np.flatnonzero(apart <= most).tolist()]
        else:
            own = int.from_bytes(bits, "little")
            found = [(d, i) for i in at if (d := (self.bits[i] ^ own).bit_count()) * (100 + percent) <= (self.n[i] + n) * (100 - percent)]
        return [x for x in found if self.comp[x[1]] != comp]


def _labels_of(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, n, d1, d2, c1, c2): entries with their component."""
    known = lists.select("sig", "d1", "d2", "n").join(labels, ["d1", "d2"], "left")
    return known.select("sig", "n", "d1", "d2", F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"))


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, n, d1, d2): entries of lists that hold several components."""
    known = _labels_of(lists, labels)
    mixed = known.groupBy("sig").agg(F.min("c1").alias("a"), F.max("c1").alias("b"), F.min("c2").alias("c"), F.max("c2").alias("d")).where("a <> b or c <> d").select("sig")
    return known.select("sig", "n", "d1", "d2").join(mixed, "sig")


def _crossing(mixed: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, closest: bool) -> DataFrame:
    """(x1, x2, y1, y2): pairs of one list whose components differ, and whose sizes and bitmaps allow a link; with
    closest, of each entry's pairs in a list only the one whose bitmaps differ least."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = _labels_of(mixed, labels).join(sketches.select("d1", "d2", "sketch"), ["d1", "d2"])
    dealt = drawn.select("sig", "n", "d1", "d2", "c1", "c2", "sketch").repartition(parts, "sig").sortWithinPartitions("sig", "n", "d1", "d2")
    names = ["x1", "x2", "y1", "y2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, window = None, _Window()
        seen: set[tuple] = set()
        for batch in batches:
            out: list[tuple] = []
            for s, n, d1, d2, c1, c2, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != sig:
                    sig, window = s, _Window()
                found = window.near(n, (c1, c2), bits, percent)
                for _, i in [min(found)] if closest and found else found:
                    d, e = (d1, d2), window.who[i]
                    pair = (*d, *e) if e < d else (*e, *d)
                    if pair not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(pair)
                        out.append(pair)
                window.add(n, (d1, d2), (c1, c2), bits)
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return dealt.mapInArrow(run, "x1 long, x2 long, y1 long, y2 long").distinct()


def _grown(found: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and component labels with more links; labels are worked out anew only if there are any."""
    more = materialise(more, "links")
    if more.isEmpty():
        return found, labels
    found = found.unionByName(more)
    return found, components(found)


def _labelled(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, digest, hash of the text), distinct sets, and the component label of each linked set."""
    need(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")
    profiles = materialise(_profiles(docs, n), "profiles")
    rows = profiles.where("chunk < 0").select("doc_id", "n_shingles", "d1", "d2", "xh")
    lists = materialise(_lists(_index(docs, n, percent, _frequencies(profiles)), percent), "lists")
    sets = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min("xh").alias("xh"))
    wanted = materialise(lists.select("d1", "d2").distinct().join(sets, ["d1", "d2"]).select("d1", "d2", "xh"), "wanted")
    sketches = materialise(_sketches(docs, wanted, n), "sketches")
    stars = lists.where("p1 is not null").select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), F.col("p1").alias("y1"), F.col("p2").alias("y2")).where("x1 <> y1 or x2 <> y2").distinct()
    found = materialise(_verify(materialise(_plausible(stars, sketches, percent), "stars"), docs, wanted, n, percent), "links")
    labels = components(found)
    # What the pivots left apart: first each entry with the closest entry of another component, then, between what is
    # still apart, all pairs that can be linked.
    mixed = materialise(_mixed(lists.where("many"), labels), "mixed")
    near = materialise(_crossing(mixed, labels, sketches, percent, closest=True), "near")
    found, labels = _grown(found, labels, _verify(near, docs, wanted, n, percent))
    rest = materialise(_crossing(_mixed(mixed, labels), labels, sketches, percent, closest=False).join(near, ["x1", "x2", "y1", "y2"], "left_anti"), "rest")
    found, labels = _grown(found, labels, _verify(rest, docs, wanted, n, percent))
    return rows, sets, labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of documents linked by Jaccard similarity.

    A document's set holds its distinct n-word shingles (A-Z lower-cased, words between ASCII white space); with fewer
    words the whole sequence is one shingle; null and empty texts have no set and are linked with nothing. Two documents
    link when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable. Nothing is sampled
    or capped: every link between different sets is found or its ends are already in one component.

    Rows that repeat a doc_id are nodes of their own that share the id; rows with a null id link like others and have a
    null component_id only if no id can be reached. Other columns are ignored; an empty table gives an empty table.
    """
    rows, sets, labels = _labelled(docs, n, percent)
    named = sets.join(labels, ["d1", "d2"], "left").select("d1", "d2", "first", F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"))
    least = named.groupBy("c1", "c2").agg(F.min("first").alias("component_id"))
    classes = named.join(least, ["c1", "c2"]).select("d1", "d2", "component_id")
    full = rows.where("n_shingles > 0").join(classes, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of linked rows, that of the least doc_id (nulls last) and then of the least hash of the
    text; columns stay. Rows are told apart by id and text: of rows equal in both one stays, if the text has words, and
    rows without words, which link with nothing, all stay."""
    rows, sets, labels = _labelled(docs, n, percent)
    named = sets.join(labels, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"))
    full = rows.where("n_shingles > 0").join(named, ["d1", "d2"]).select("doc_id", "xh", "c1", "c2")
    heads = full.groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "xh")).alias("head"))
    other = full.join(heads, ["c1", "c2"]).where(~F.col("doc_id").eqNullSafe(F.col("head.doc_id")) | (F.col("xh") != F.col("head.xh")))
    gone = other.select(F.col("doc_id").alias("_id"), F.col("xh").alias("_h")).distinct()
    keyed = docs.withColumn("_xh", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_xh") == F.col("_h"))
    kept = keyed.join(gone, same, "left_anti")
    twice = rows.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("xh").alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1")
    if not twice.isEmpty():
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_xh"]))
    return kept.drop("_xh")
