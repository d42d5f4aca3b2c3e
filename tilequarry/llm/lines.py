"""Line dedup by an exact set-similarity join of line tokens; DataFrame and SQL functions only.

Two lines match when the Jaccard similarity t of their sets of lower-cased words reaches the threshold; a line that matches
an earlier one (of a smaller doc_id, or higher up in the same document) is removed. Equal lines are one class, known by
its first line, and only classes are joined.

Words have one global order, rare ones first. Of two similar sets let one lack a words of the other and have b of its own:
2 a + b is at most 2 (1 - t) n for a set of n. A word that the other set lacks breaks two pairs of neighbours in that
order, a word of the other set's own breaks one. So similar sets have one of their first 2 (1 - t) n + 1 pairs of
neighbours in common, and these pairs are the index keys (the prefix). Sets that have nothing to do with each other share
many words, but hardly ever a pair of neighbours, so lists hold little besides similar lines at any size of the corpus.
Postings carry the size of the set, the place of the pair and a parity bitmap, whose difference never exceeds the sets'
difference, for the length, position and bitmap filters; a longer bitmap ends most other chance pairs before any words
move. What is left is verified on the words of both lines.

One earlier match settles a line. So a class is first held against the likeliest earlier class alone, where in long lists
only the earliest class counts; then against the other candidates, and only if none is similar, against all of its longest
list, then of its other long ones. Most variants of one line thus give one pair each.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import WORD_GAP, discard, materialise, materialise_bucketed, need
from .sharding import number_rows

#: Slots of the table of word frequencies; fixed, so what every task holds never grows. With 2^16 chance candidates
#: more than double on the check tool's tables.
SLOTS = 1 << 18
#: Bits for any line number: arrays of lines have 31-bit places.
LINE_BITS = 31
#: The largest size and place that a posting states; the filters let longer lines pass.
MOST = (1 << 16) - 1
#: Classes of a list up to which all its pairs are looked at; in longer lists the earliest class comes first.
SHORT = 16
#: Longest lists that a row of a long list knows of its class; more only save work.
TOPS = 4
#: Words of a set from which a second parity bitmap is worth its time.
WIDE = 64
#: ASCII white space other than the space and the line feed.
_GAPS = "\t\x0b\x0c\r"


def _ids(line: str) -> Column:
    """Hashes of the distinct lower-cased words, in no order. 64 bits tell the words of a corpus apart."""
    odd = reduce(or_, (F.col(line).contains(c) for c in _GAPS))  # looks at bytes; a pattern would decode every line
    words = F.lower(F.when(odd, F.translate(line, _GAPS, " " * len(_GAPS))).otherwise(F.col(line)))
    hashed = F.transform(F.split(words, " ", -1), lambda w: F.xxhash64(w))
    return F.array_except(hashed, F.array(F.expr("xxhash64('')")))


def _rows(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with _row, which tells rows apart and orders them, and the bits that line numbers take below it.

    It is the id, counted from the least one, if each id has one text and there is room; else the rank among the distinct
    ids and hashes of texts. A null id comes before all others. Texts are looked at only where ids repeat or lie too far
    apart for line numbers of any text.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    ids = F.col("doc_id").cast("long") if whole else F.lit(0).cast("long")
    counted = lambda low: F.coalesce(F.col("doc_id").cast("long") - F.lit(low - 1), F.lit(0)).cast("long")
    if whole:
        s = docs.select(ids.alias("id")).groupBy("id").count().agg(F.max("count").alias("most"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        low = s["low"] or 0
        if (s["most"] or 0) <= 1 and ((s["high"] or 0) - low + 1).bit_length() + LINE_BITS <= 62:
            return docs.withColumn("_row", counted(low)), LINE_BITS
    part = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    feeds = F.octet_length("text")  # no fewer than its line feeds
    each = docs.select(ids.alias("id"), part.alias("part"), feeds.alias("feeds")).groupBy("id").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.max("feeds").alias("feeds"))
    s = each.agg(F.bool_or(F.expr("a <> b")).alias("several"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("feeds").alias("feeds")).first()
    bits, low = (s["feeds"] or 0).bit_length(), s["low"] or 0
    if whole and not s["several"] and ((s["high"] or 0) - low + 1).bit_length() + bits <= 62:
        return docs.withColumn("_row", counted(low)), bits
    known = number_rows(docs.select(F.col("doc_id").alias("_id"), part.alias("_part")).distinct(), ["_id", "_part"], "_row")
    numbered = docs.withColumn("_h", part).join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_part")))
    return materialise(numbered.drop("_id", "_part", "_h"), "numbered"), bits


def split_lines(docs: DataFrame, bits: int) -> DataFrame:
    """(a, b, pos, line): lines that have a word, two hashes of them, and their places: the row and the line's number."""
    each = docs.select("_row", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")
    pos = F.shiftleft("_row", bits).bitwiseOR(F.col("i").cast("long"))
    return each.select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), pos.alias("pos"), "line")


def _classes(docs: DataFrame, bits: int) -> DataFrame:
    """(a, b, pos, copies, n, p0, p1, w): the first of equal lines, whether it has copies, its words, their number and parity
    bitmap; p1 is null in small sets."""
    # min_by() compares plain numbers; the least of structs would build and compare one for each line.
    first = split_lines(docs, bits).groupBy("a", "b").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.max("pos").alias("last"))
    sets = first.select("a", "b", "pos", (F.col("last") > F.col("pos")).alias("copies"), _ids("line").alias("w"))
    bit = "shiftleft(1L, hash(x))"  # a shift takes the last 6 bits; a cast would check for overflow
    p0, p1 = (F.expr(f"aggregate(w, 0L, (p, x) -> {b})") for b in (f"p ^ {bit}", f"if(x < 0, p ^ {bit}, p)"))
    return sets.select("a", "b", "pos", "copies", F.size("w").alias("n"), p0.alias("p0"), F.when(F.size("w") > WIDE, p1).alias("p1"), "w")


def _order(classes: DataFrame) -> Column:
    """The table of word frequencies: for each slot of the hashes the logarithm of its count over all classes, in parts of
    the mean count; 0 up to twice the mean. Frequent words stand out of the mean at any size of the corpus. The logarithms
    stand in the first 12 bits."""
    # Eight slots a row: so few keys stay in the first level of Spark's hash aggregate.
    slot = F.expr(f"cast(w & {SLOTS - 1}L as int) >> 3")
    each = [F.count(F.when(F.col("w").bitwiseAND(F.lit(7)) == i, 1)).alias(f"k{i}") for i in range(8)]
    found = classes.select(F.explode("w").alias("w")).groupBy(slot.alias("s")).agg(*each).toPandas()  # SLOTS / 8 rows at most
    table = np.zeros((SLOTS // 8, 8))
    table[found["s"].to_numpy()] = found.drop(columns="s").to_numpy()
    table = table.ravel()
    mean = max(table.mean(), 1e-9)
    codes = np.where(table > 2 * mean, 8 * np.log2(np.maximum(table / mean, 1)), 0).astype(int)
    return F.split(F.lit(",".join(str(c << 52) for c in codes.tolist())), ",", -1).cast("array<bigint>")


def _ranked(table: Column) -> Column:
    """The words w in the global order: the code of their slot, then their hash."""
    # Files give arrays that may hold nulls, which are sorted as objects; these hold none and are sorted as plain longs.
    rank = lambda w: table[w.bitwiseAND(F.lit(SLOTS - 1))].bitwiseOR(w.bitwiseAND(F.lit((1 << 52) - 1)))
    return F.sort_array(F.transform("w", lambda w: F.coalesce(rank(w), F.lit(0).cast("long"))))


def _postings(classes: DataFrame, table: Column, percent: int) -> DataFrame:
    """(key, m, pos): the index keys of each class; m holds size, 32 bits of parity and place. Below t = 0.8 short sets
    may have too few pairs of neighbours, so there the first words alone are the keys."""
    bits = F.col("p0").bitwiseXOR(F.shiftrightunsigned("p0", 32)).bitwiseAND(F.lit((1 << 32) - 1))
    size = F.shiftleft(F.least("n", F.lit(MOST)).cast("long"), 48)
    sets = classes.select("pos", "n", size.bitwiseOR(F.shiftleft(bits, 16)).alias("m"), _ranked(table).alias("ids"))
    # Keys are worked out behind posexplode(), not in a lambda function, which Spark does not compile.
    if percent >= 80:
        # A set that is similar to equal sets only has one key, the whole of it.
        whole = f"(100 * n div {percent} = n and {100 - percent} * n < 100)"
        first = f"if{whole[:-1]}, 1, least(n - 1, {_broken('n', percent)} + 1))"
        key = F.expr(f"if{whole[:-1]}, xxhash64(ids), x ^ shiftleft(get(ids, place + 1), 7))")
    else:
        first, key = f"{100 - percent} * n div 100 + 1", F.col("x")
    each = sets.select("pos", "m", "n", "ids", F.posexplode(F.expr(f"slice(ids, 1, {first})")).alias("place", "x"))
    return each.select(key.alias("key"), F.expr(f"m | cast(least(place, {MOST}) as long)").alias("m"), "pos")


def _broken(n: str, percent: int) -> str:
    """The most pairs of neighbours of a set of n that a similar set lacks: the most of 2 a + b, where
    100 a <= (100 - percent) n - percent b. From 80 percent on more than three words of the other set's own never add to it."""
    return f"greatest({', '.join(f'2 * (({100 - percent} * {n} - {percent * b} + 400) div 100 - 4) + {b}' for b in range(4))})"


def _needed(x: str, y: str, percent: int) -> str:
    """The words that sets of these sizes must share."""
    return f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent})"


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether two postings of a key, by their m, can belong to similar sets: sizes, places of the key and bitmaps."""
    nx, ny = (f"shiftrightunsigned({m}, 48)" for m in (x, y))
    px, py = (f"({m} & {MOST})" for m in (x, y))
    needed = _needed(nx, ny, percent)
    return F.expr(
        f"greatest({nx}, {ny}) = {MOST} or (100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny})"
        f" and least({px}, {py}) + least({nx} - {px}, {ny} - {py}) >= {needed}"
        f" and bit_count(({x} ^ {y}) & {((1 << 32) - 1) << 16}L) <= {nx} + {ny} - 2 * {needed})"
    )


def _apart(x: str, y: str) -> str:
    """Places in which two parity bitmaps differ, never more than the sets have words of their own. p0 is the parity of
    all words in 64 places, p1, if both sets have it, that of the words with a negative hash."""
    return f"coalesce(bit_count({x}1 ^ {y}1) + bit_count({x}0 ^ {x}1 ^ {y}0 ^ {y}1), bit_count({x}0 ^ {y}0))"


def _verify(near: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, y) of the pairs (x earlier, y later) whose sets are similar, by their words."""
    ends = near.select(F.col("x_a").alias("a"), F.col("x_b").alias("b")).unionByName(near.select(F.col("y_a").alias("a"), F.col("y_b").alias("b"))).distinct()
    texts = materialise(classes.select("a", "b", "w").join(ends.hint("shuffle_hash"), ["a", "b"]), "texts")
    pairs = near.select("x_a", "x_b", "y_a", "y_b", "y", "x_n", "y_n")
    for k in ("y", "x"):
        pairs = pairs.join(texts.select(*(F.col(c).alias(f"{k}_{c}") for c in ("a", "b", "w"))), [f"{k}_a", f"{k}_b"])
    same = pairs.where(f"size(array_intersect(x_w, y_w)) >= {_needed('x_n', 'y_n', percent)}")
    out = materialise(same.select(F.col("y_a").alias("a"), F.col("y_b").alias("b"), "y").distinct(), "matches")
    discard(texts)
    return out


def later_matches(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, y) of the classes that are similar to an earlier class; y is the place."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = _postings(classes, _order(classes), percent).repartition(parts, "key")
    whole = Window.partitionBy("key")
    # Plain numbers, not the least of structs: nearly all of the many lists have one row.
    seen = lists.select("*", F.count("*").over(whole).alias("k"), F.min("pos").over(whole).alias("first"), F.min_by("m", "pos").over(whole).alias("first_m")).where("k > 1")
    later = F.expr("first < pos")
    marked = seen.select("key", "pos", "m", "k", "first", later.alias("later"), (later & _possible("first_m", "m", percent)).alias("star"))
    shared = materialise(marked.where("k > 2 or star"), "shared", plain=["key", "pos", "m"])
    sides = classes.select("a", "b", "pos", "n", "p0", "p1")
    side = lambda k: sides.select(F.col("pos").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in sides.columns if c != "pos")).hint("shuffle_hash")
    near = F.expr(f"{_apart('x_p', 'y_p')} <= x_n + y_n - 2 * {_needed('x_n', 'y_n', percent)}")

    def close(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.select("x", "y").join(side("y"), "y").join(side("x"), "x").where(near), "near")

    def named(rows: DataFrame, k: str) -> DataFrame:
        return rows.select("key", *(F.col(c).alias(k if c == "pos" else f"{k}_{c}") for c in ("pos", "m", "a", "b", "n", "p0", "p1", "tops") if c in rows.columns))

    # All pairs of short lists; those with the earliest class in long ones and in lists of two.
    short = shared.where(f"k between 3 and {SHORT}")
    stars = shared.where(f"star and (k = 2 or k > {SHORT})").select(F.col("first").alias("x"), F.col("pos").alias("y"), (F.col("k") == 2).alias("short"))
    pairs = named(short, "x").join(named(short.where("later"), "y"), "key").where(F.expr("x < y") & _possible("x_m", "y_m", percent)).select("x", "y", F.lit(True).alias("short"))
    shares = stars.unionByName(pairs).groupBy("x", "y").agg(F.count("*").alias("c"), F.bool_or("short").alias("short"))
    # A class has at most SHORT candidates for each of its keys.
    likely = Window.partitionBy("y").orderBy(F.desc("c"), "x")
    candidates = materialise(shares.withColumn("r", F.row_number().over(likely)), "candidates")
    # First the one with which a class shares most keys.
    best = close(candidates.where("r = 1"))
    found = _verify(best, classes, percent)
    # Then, for classes that have no match yet, the others; chance meets in one long list are left to the long lists.
    tested = "r = 1 or short or c > 1"
    others = close(candidates.where(f"r > 1 and ({tested})").join(found.select("y"), "y", "left_anti"))
    also = _verify(others, classes, percent)
    matched = found.unionByName(also)
    # Last, all earlier classes of their long lists: first of the longest one, where most variants of a line meet. Rows
    # know a few longest lists of their class, so those met there are passed over in the others.
    longest = Window.partitionBy("pos").orderBy(F.desc("k"), "key")
    long = shared.where(f"k > {SHORT}").select("key", "pos", "m", "later", F.row_number().over(longest).alias("r"))
    tops = F.sort_array(F.collect_list(F.when(F.col("r") <= TOPS, F.struct("r", "key"))).over(Window.partitionBy("pos")))["key"]
    rows = materialise(long.withColumn("tops", tops).join(sides.hint("shuffle_hash"), "pos"), "rows")
    open_ = materialise(rows.where("later").join(matched.select(F.col("y").alias("pos")), "pos", "left_anti"), "open")

    def listed(asked: DataFrame, done: DataFrame, new: Column) -> DataFrame:
        met = named(rows, "x").join(named(asked, "y"), "key").where(F.expr("x < y") & new & _possible("x_m", "y_m", percent) & near)
        pairs = met.select("x", "y", *(f"{k}_{c}" for k in ("x", "y") for c in ("a", "b", "n"))).distinct()
        return materialise(pairs.join(done.select("x", "y"), ["x", "y"], "left_anti"), "near")

    done = candidates.where(tested)
    one = listed(open_.where("r = 1"), done, F.lit(True))
    once = _verify(one, classes, percent)
    left = open_.where("r > 1").join(once.select(F.col("y").alias("pos")), "pos", "left_anti")
    last = listed(left, done.select("x", "y").unionByName(one.select("x", "y")), F.expr("not array_contains(x_tops, y_tops[0])"))
    rest = _verify(last, classes, percent)
    out = materialise(matched.unionByName(once).unionByName(rest), "matches")
    discard(shared, candidates, best, found, others, also, rows, open_, one, once, last, rest)
    return out


def removed_lines(docs: DataFrame, bits: int, percent: int = 80, min_tokens: int = 1) -> DataFrame:
    """(pos) of the lines to remove; for docs and bits see _rows."""
    every, drop = materialise_bucketed(_classes(docs, bits), ["a", "b"], "classes", plain=["a", "b", "pos", "p0", "p1"])
    classes = every.where(F.col("n") >= max(1, min_tokens))
    matches = later_matches(classes, percent)
    gone = matches.select("a", "b", F.lit(True).alias("gone")).hint("shuffle_hash")
    # Written without the buckets: a line that stands almost everywhere is then a skewed join, which Spark splits.
    known = materialise(classes.select("a", "b", F.col("pos").alias("first"), "copies").join(gone, ["a", "b"], "left").where("gone or copies").drop("copies"), "firsts")
    placed = split_lines(docs, bits).select("a", "b", "pos").join(known.hint("shuffle_hash"), ["a", "b"])
    out = materialise(placed.where("gone or pos <> first").select("pos"), "removed")
    drop()
    discard(matches, known)
    return out


def dedup_lines(docs: DataFrame, percent: int = 80, min_tokens: int = 1) -> DataFrame:
    """docs with text without the removed lines, and with n_lines and n_removed.

    Lines are the parts of the text between line feeds; those without words are kept, and so are lines of fewer than
    min_tokens distinct words (production: 1, every line with a word is compared). What is left keeps its order and its
    line feeds. A null text stays null, with 0 lines; an empty text has one line without words. Rows with one doc_id and
    one text are read as one document: they get equal verdicts and all stay. Other texts of the id are documents of their
    own, in the order of their hashes. Rows with a null id come before all others; ids that are no whole numbers keep the
    order of their type. Other columns stay; columns named n_lines or n_removed are replaced; an empty table gives an
    empty table. Lines are told apart by 128 bits of hash, words by 64.
    """
    need(docs, "doc_id", "text")
    docs = docs.drop("n_lines", "n_removed", "_row", "_gone", "_lines")
    names = docs.columns
    docs, bits = _rows(docs)
    line = F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    gone = removed_lines(docs, bits, percent, min_tokens).groupBy(F.shiftright("pos", bits).alias("_row")).agg(F.collect_set(line).alias("_gone"))
    keyed = docs.join(gone.hint("shuffle_hash"), "_row", "left").withColumn("_lines", F.split("text", "\n", -1))
    kept = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    return keyed.select(*(text.alias(c) if c == "text" else F.col(c) for c in names), F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"))


def with_text_left(deduped: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a deduplicated table, but for those that lost lines and keep no word: they are copies of what stands
    elsewhere. A line too short to be compared matches nothing, so it keeps its document. Documents that lost nothing
    stay, empty ones included."""
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), WORD_GAP, -1), lambda w: w != "")
    return deduped.where((F.col("n_removed") == 0) | (F.size(words) > 0)).select(*columns)
