"""Line dedup, packing, sharding, top-k search, the n-gram join and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tilequarry.llm import common, lines, oracle, packing, queries, sharding, shingles, topk

GAP = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_matches_sql(spark, small, duck, name):
    same_rows(queries.QUERIES[name](spark, small), duck.execute(oracle.ORACLE_SQL[name]))


def _dedup(rows, percent, least):
    kept, before = {}, []
    for i, text in sorted(rows):
        out = []
        for line in text.split("\n"):
            w = frozenset(x for x in GAP.split(line.lower()) if x)
            if len(w) >= max(1, least):
                if any(100 * len(w & b) >= percent * len(w | b) for b in before):
                    before.append(w)
                    continue
                before.append(w)
            out.append(line)
        kept[i] = "\n".join(out)
    return kept


@pytest.mark.parametrize("percent, least", [(80, 1), (60, 3)])
def test_line_dedup_against_all_pairs(spark, percent, least):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(25)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            text.append(" ".join(line).upper() if rng.random() < 0.1 else "  ".join(line))
        rows.append((i, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, percent, least).collect()}
    assert got == _dedup(rows, percent, least)


def test_line_dedup_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    rows = [(None, "a b c", "x"), (1, "a b c\n\n z", "x"), (1, "a b c\n\n z", "x"), (2, None, None), (3, "", None), (4, "c b a\nz", "x"), (5, long, "y"), (6, long + "\nq", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == sorted([(-1, "a b c", 1, 0), (1, "\n z", 3, 1), (1, "\n z", 3, 1), (2, None, 0, 0), (3, "", 1, 0), (4, "", 2, 2), (5, long, 1, 0), (6, "q", 2, 1)], key=str)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(None, "a b c d e\nunique one two three four"), (None, "x y z p q\na b c d e"), (7, "k l m n o\nfirst of seven here"), (7, "r s t u v\nk l m n o")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"] for r in lines.dedup_lines(df).collect()]
    assert sorted(line for t in got for line in t.split("\n") if line) == sorted({line for _, t in rows for line in t.split("\n")})
    assert sum(t.count("a b c d e") for t in got) == sum(t.count("k l m n o") for t in got) == 1
    rows = [(None, "p q r s t u"), (1, "p q r s t u"), (None, "all other words stand here"), (2, "p q r s t u"), (2, "two has a text more"), (None, "no id but a copy"), (None, "no id but a copy"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in shingles.keep_one(df).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[4], rows[5], rows[7], rows[8]], key=str)


def test_line_dedup_stage_keeps_documents_of_short_lines(spark):
    notice = "this line is a license notice that all share"
    rows = [(1, notice + "\nMore.", "en"), (2, notice + "\n- Who is there?\n- Me.", "en"), (3, notice, "en"), (4, notice + "\n\n  ", "en"), (5, "", "en"), (6, None, None)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "- Who is there?\n- Me.", 5: "", 6: None}


def _pack(sizes, sources, clusters, capacity, share):
    bins, most, out = [], max(1, int(capacity * share)), {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        best = None
        for b, (left, used, held) in enumerate(bins):
            mine = used.get(sources[i], 0)
            if left >= sizes[i] and clusters[i] not in held and mine < most and mine + sizes[i] <= max(most, 0 if used else sizes[i]) and (best is None or (left, b) < best):
                best = (left, b)
        if best is None:
            bins.append([capacity, {}, set()])
            best = (capacity, len(bins) - 1)
        b = best[1]
        bins[b][0] -= sizes[i]
        bins[b][1][sources[i]] = bins[b][1].get(sources[i], 0) + sizes[i]
        bins[b][2].add(clusters[i])
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_full_search(seed):
    rng = random.Random(seed)
    n = 300
    sizes = [rng.randint(0, 100) for _ in range(n)]
    sources = [0 if rng.random() < 0.4 else rng.randint(1, 5) for _ in range(n)]
    clusters = [0 if rng.random() < 0.1 else rng.randint(1, 200) for _ in range(n)]
    assert packing.pack_group(sizes, sources, clusters, 100, 0.75) == _pack(sizes, sources, clusters, 100, 0.75)


def test_packing_keeps_every_token(spark):
    rows = [(i, rng, f"s{i % 3 if i % 2 else 0}", "c" if i < 20 else f"c{i}") for i, rng in enumerate(random.Random(1).choices(range(0, 300), k=200))]
    rows += [(900, 1050, None, None), (901, None, None, None), (None, 5, "s", None), (902, 200, "s", "k"), (3, rows[3][1], "s1", "c")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    got = packing.pack(df, capacity=100, group=64).collect()
    per_doc, bins = defaultdict(int), defaultdict(list)
    for r in got:
        per_doc[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append(r)
    want = defaultdict(int)
    for i, n, _, _ in rows:
        want[i] += n or 0
    assert per_doc == want
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) <= 100
        at = 0
        for r in sorted(b, key=lambda r: (r["bin_offset"], r["n_tokens"])):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
    copies = [b for b, rs in bins.items() for r in rs if r["doc_id"] is not None and r["doc_id"] < 20 and r["piece"] == r["n_pieces"] - 1]
    assert len(copies) == len(set(copies)) == 21
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_odd_rows_and_layouts(spark):
    rows = [(1152921504606846977, 30, "s", "k"), (None, 40, None, None), (None, 40, None, None), (5, 0, "s", "k"), (6, -3, "s", None)] + [(7, 25, "t", "c")] * 30
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    got = packing.pack(df, capacity=100, group=8).collect()
    assert 1152921504606846977 in {r["doc_id"] for r in got} and len(got) == len(rows)
    again = packing.pack(df.orderBy(F.rand(2)).repartition(7), capacity=100, group=8).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    docs = spark.createDataFrame([(None, None, "s", 1), (1, "a b", None, 2)], "doc_id long, text string, source string, bin_id int")
    assert sorted(r["n_tokens"] for r in packing.pack_documents(docs).collect()) == [1, 3]


def test_top_k_counts_every_row_of_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (2, [0.6, 0.0]), (2, [0.6, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search_embeddings(df, k=2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 230 * 256), (0, 2, 2, 153 * 256)]


def test_line_dedup_ids_that_are_no_numbers(spark):
    rows = [("x1", "one two three\nfour five"), ("x2", "one two three\nsix"), (None, "six"), ("x3", None)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"x1": rows[0][1], "x2": "", None: "six", "x3": None}


def test_line_dedup_numbers_rows_without_their_texts(spark):
    unread = spark.range(5, 8).select(F.col("id").alias("doc_id"), F.raise_error(F.lit("a text was read")).cast("string").alias("text"))
    docs, bits = lines._rows(unread)
    assert [r["_row"] for r in docs.select("_row").collect()] == [1, 2, 3] and bits == lines.LINE_BITS


@pytest.mark.parametrize("far", [0, 1 << 30, 1 << 31, 1 << 45, 1 << 62])
def test_line_dedup_ids_far_apart(spark, far):
    rows = [(-far - 1, "one two three\nfour five"), (far, "six\none two three"), (far + 1, "five four\nseven"), (None, "seven")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {far: "six", far + 1: ""}


def test_line_dedup_long_lists(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(24)]
    rows = []
    for i in range(150):  # variants of one line, more than a short list holds, some too far from the first
        line = list(base)
        for _ in range(rng.randint(0, 7)):
            line[rng.randrange(len(line))] = f"v{rng.randint(0, 30)}"
        rows.append((i, " ".join(line)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _dedup(rows, 80, 1)


def test_materialised_plans_are_described_briefly(spark):
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    common.materialise(spark.range(3).select("id", F.lit("briefly" * 5000).alias("long")))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    kept = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [p for p in (kept.apply(i).physicalPlanDescription() for i in range(kept.size())) if "brieflybriefly" in p]
    assert plans and max(map(len, plans)) < 10_000
    assert spark.conf.get("spark.sql.maxPlanStringLength") == before


def test_line_dedup_has_no_more_keys_than_suffice(spark):
    for percent in (80, 85, 90, 95):
        most = lambda n: max(2 * (((100 - percent) * n - percent * b) // 100) + b for b in range(n) if percent * b <= (100 - percent) * n)  # noqa: E731, B023
        got = spark.range(1, 200).selectExpr("id", f"{lines._broken('id', percent)} AS k").collect()
        assert [r["k"] for r in got] == [most(r["id"]) for r in got]
    docs, bits = lines._rows(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(43)))], "doc_id long, text string"))
    classes = lines._classes(docs, bits)
    assert lines._postings(classes, lines._order(classes), 80).count() == 17


def test_line_dedup_sorts_plain_numbers(spark):
    docs, bits = lines._rows(spark.createDataFrame([(1, "a b c d e f g"), (2, "x\ty z")], "doc_id long, text string"))
    classes = common.materialise(lines._classes(docs, bits))  # as read from files, where any array may hold nulls
    ranked = classes.select(lines._ranked(lines._order(classes)).alias("ids"))
    assert ranked.schema["ids"].dataType.containsNull is False
    assert sorted(len(r["ids"]) for r in ranked.collect()) == [3, 7] and all(r["ids"] == sorted(r["ids"]) for r in ranked.collect())


def test_line_dedup_white_space_of_every_kind(spark):
    rows = [(0, "one two three four five six")] + [(i, c.join("One two three four five six".split())) for i, c in enumerate("\t\x0b\x0c\r", 1)]
    rows += [(9, "one\u2003two\u2003three\u2003four\u2003five\u2003six")]  # no gap: one word
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {i: "" for i in range(1, 5)}


def test_line_dedup_where_most_lists_are_long(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHORT", 2)
    monkeypatch.setattr(lines, "TOPS", 1)
    rng = random.Random(11)
    rows = []
    for i in range(160):  # drifting variants of two lines, so that many match others than the first
        line = [f"{'ab'[i % 2]}{j}" for j in range(20)]
        for _ in range(rng.randint(0, 8)):
            line[rng.randrange(len(line))] = f"v{rng.randint(0, 12)}"
        rows.append((i, " ".join(line)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _dedup(rows, 80, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1024])
def test_permutation(n):
    seed, x = 42, np.arange(n, dtype=np.int64)
    a, b = sharding.sides(n)
    box = np.arange(a * b, dtype=np.int64)
    assert sorted(sharding.feistel_numpy(box, n, seed).tolist()) == box.tolist() and n <= a * b < n + a
    for _ in range(sharding.longest_walk(n, seed)):
        x = np.where((_ > 0) & (x < n), x, sharding.feistel_numpy(x, n, seed))
    assert sorted(x.tolist()) == list(range(n))


def test_sharding(spark):
    rows = [(i, "t" * (i % 7)) for i in range(500)] + [(None, None), (3, "ttt"), (3, "ttt"), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    got = sharding.shard_documents(df).collect()
    again = sharding.shard_documents(df.orderBy(F.rand(3))).collect()
    key = lambda r: (str(r["doc_id"]), r["shard"], r["slot"])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == 504 and len({key(r)[1:] for r in got}) == 504
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} <= {31, 32}
    null = next(r for r in got if r["doc_id"] is None)
    assert null["size"] == 1 and null["text_crc32"] == 0
    assert sharding.shard_documents(df.limit(0)).count() == 0
    assert sharding.shard_documents(df.limit(1)).first()["slot"] == 0


def test_place_is_computable(spark):
    n = 777
    df = sharding.shard_rows(spark.range(n).withColumnRenamed("id", "k"), ["k"], 5, 9).collect()
    x = np.arange(n, dtype=np.int64)
    for _ in range(sharding.longest_walk(n, 9)):
        x = np.where((_ > 0) & (x < n), x, sharding.feistel_numpy(x, n, 9))
    for r in df:
        assert r["row_number"] == r["k"] and (r["shard"], r["slot"]) == (x[r["k"]] % 5, x[r["k"]] // 5)


def test_top_k_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(float).tolist()) for i in range(90)] + [(100 + i, [0.5] * 6) for i in range(40)]
    odd = [(200, None), (250, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (300, [float("nan")] * 6), (301, [float("inf")] * 6), (350, [0.25, 0.5]), (351, [1.0, 1.0]), (None, [0.5] * 6), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = sorted(map(tuple, topk.search_embeddings(df).collect()))
    good = dict(rows) | {350: [0.25, 0.5], 351: [1.0, 1.0]}
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in good.items()}
    want = []
    for q in sorted(whole):
        if q % 50 == 0:
            scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert got == want
    assert topk.search_embeddings(df.limit(0)).count() == 0


def _sets(rows, n):
    out = []
    for _, text in rows:
        w = (text or "").encode().translate(shingles._LOWER).split()
        out.append({tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set())
    return out


def _components(rows, n, percent):
    sets, up = _sets(rows, n), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(s), min(least[root(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("n, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_ngram_join_against_all_pairs(spark, n, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = list(rng.choice(base[:3] if i % 3 else base))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text).title() if i % 10 == 0 else "\t".join(text)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (None, "alone word"), (7, rows[7][1]), (503, "Q"), (504, "q"), (505, "a b c"), (506, "a b  c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = sorted(map(tuple, shingles.near_duplicates(df, n, percent).collect()), key=str)
    assert got == _components(rows, n, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        size = int(rng.integers(1, 80))
        common = rng.integers(0, 1 << 62, size).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common[rng.random(size) > 0.06], rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64)])) for _ in range(2))
        k = len(np.intersect1d(a, b))
        if not k or not shingles.linked(k, len(a), len(b), percent) or np.array_equal(a, b):
            continue
        limit = int(rng.integers(0, 12))
        sa, sb = (shingles.signatures(x, x % np.uint64(10), limit, percent) for x in (a, b))
        assert len(np.intersect1d(sa, sb)), (len(a), len(b), k, limit)
        apart = sum((x ^ y).bit_count() for x, y in zip(shingles.sketch(a), shingles.sketch(b), strict=True))
        assert apart <= len(a) + len(b) - 2 * k


def test_components_of_chains(spark):
    chain = [(0, i, 0, i + 1) for i in range(20)] + [(1, 5, 1, 6), (1, 6, 1, 5)]
    got = shingles.components(spark.createDataFrame(chain, "x1 long, x2 long, y1 long, y2 long")).collect()
    assert {(r["d1"], r["d2"]): (r["c1"], r["c2"]) for r in got} == {**{(0, i): (0, 0) for i in range(21)}, (1, 5): (1, 5), (1, 6): (1, 5)}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]

    def prose(n):
        return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n))

    docs = [(i, prose(8), "en", f"s{i % 3}", 0) for i in range(120)]
    docs = [(i, t + " grobword" if i % 6 == 1 else t, *r) for i, t, *r in docs]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs += [(200, docs[0][1], "en", "s0", 0), (201, prose(3) + "\n" + passage, "en", "s1", 0), (202, prose(3) + "\n" + passage, "en", "s2", 0), (203, "Short one.", "en", "s0", 0), (204, "Short one.", "en", "s0", 0), (205, None, None, None, None), (206, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 1)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.columns
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
        assert name == "best_fit_packing" or now.columns == before
    left = {r["doc_id"] for r in seen["toxicity"]}
    assert left == {d[0] for d in docs if not (d[0] < 200 and d[0] % 6 == 1)}
    after = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert set(after) == left - {200} and passage in after[201]["text"] and passage not in after[202]["text"]
    assert after[202]["n_chars"] == len(after[202]["text"]) and after[205]["text"] is None
    assert len({203, 204} & {r["doc_id"] for r in seen["ngram_jaccard"]}) == 1
    assert {r["doc_id"] for r in seen["best_fit_packing"]} <= set(after)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["best_fit_packing"])
