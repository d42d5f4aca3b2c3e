"""Toxicity, token counts, HTML extraction, quality rules and mixing."""

import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.llm import html, mixing, quality, queries, tokens, toxicity

ODD = [None, "", " ", "\n\n", "a", "ſẞİΣ ½ 一二 🙂", "x " * 30000, "it's we're 'll !!'s '", "<|endoftext|> a<|startoftext|>", "é   z"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary_path())


def test_token_counts_equal_the_library(spark, library):
    rng = random.Random(5)
    letters = "abcdefghilmnorst'  \n\té🙂ſΣİßÅ一二٣½_-!?.…’​́E\u0085"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    got = {r["doc_id"]: r for r in tokens.count_tokens(df, queries.vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False)), repr(t)
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 2048)


def test_newer_characters_count_as_in_the_library(spark, library):
    points = [p for a, b in (*tokens.NEW_LETTERS, *tokens.NEW_DIGITS) for p in range(a, b + 1)]
    texts = [t.format(chr(p)) for p in points for t in ("a{}b", "!{}!", "1{0}{0} {0}")]
    counter = tokens._counter(queries.vocabulary_path())
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_repeated_rows_and_an_empty_table(spark, library):
    df = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, None)], "doc_id long, text string")
    n = len(library.encode("some words", add_special_tokens=False))
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(df, queries.vocabulary_path()).collect()) == [0, n, n]
    assert tokens.count_tokens(df.limit(0), queries.vocabulary_path()).count() == 0


def test_token_counts_of_the_corpus(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, small).collect()}
    assert got == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False)) for r in rows}


def test_scan_does_not_depend_on_chunks():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 6, 1000).astype(np.uint8)
    state, want = tokens.FREE, []
    for k in kinds:
        want.append(bool(tokens.START[state, k]))
        state = tokens.TO[state, k]
    assert tokens.token_starts(kinds).tolist() == want
    maps = tokens.scan_maps(kinds[:960].reshape(-1, 64))
    total = np.arange(5)
    for m, p in zip(maps, tokens.prefix_compose(maps), strict=True):
        total = m[total]
        assert p.tolist() == total.tolist()


def test_distinct_spans_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(tokens, "BASES", (1, tokens.BASES[1]))  # the first hash is then a plain sum
    points = np.array([ord(c) for c in "adbcxxad"], np.uint32)
    first, which, odd = tokens.distinct_spans(points, np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8]))
    assert which[0] == which[1] == which[3] and odd.tolist() == [1] and len(first) == 2


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 1
        text = [rng.choice(words) for _ in range(40)] + (["grobword"] * rng.randint(1, 2) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None, "en", "s"), (1001, "", "en", "s"), (0, rows[0][1], "en", "s")], "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, lab).collect()
    assert len(got) == 603
    right = [r["predicted"] == int(r["doc_id"] % 5 == 1) for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(right) > 80 and np.mean(right) > 0.97
    for r in got:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert len({r["score"] for r in got if r["doc_id"] >= 1000}) == 1
    empty = toxicity.score_documents(docs.limit(0), lab.limit(0))
    assert empty.count() == 0
    assert {r["score"] for r in toxicity.score(docs.withColumn("score", F.lit("x")), (np.zeros(0, np.int64), np.zeros(0))).collect()} == {0.5}


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 5000, 50)) for _ in range(400)]
    labels = [int(i % 4 == 0) for i in range(400)]
    rows = [np.append(r, 9999) if y else r for r, y in zip(rows, labels, strict=True)]
    at, w = toxicity.train(rows, labels, buckets=10000)
    assert 9999 in at and len(at) < 500 and w[list(at).index(9999)] > 0


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><nav><a>Home</a></nav><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p>One<br>two&nbsp;<b>three</b>x<p>Four <!-- no --> five<div class="comments">Reader</div></article>
<aside>Side</aside><form>Ask</form><footer>&copy; f</footer></body></html>"""


def test_article_text():
    assert html.page_lines(PAGE) == [("A & B", True), ("One two threex", True), ("Four five", True)]
    assert html.page_lines(None) == [] and html.page_lines("<<>") == [("<<>", False)] or html.page_lines("<<>") == [("<", False)]


def test_names_inside_the_article():
    inner = '<div class="article-header"><h1>Title</h1></div><p class="side effects">Effects</p><section id="related-work"><p>Work</p></section><div class="related-posts">More</div><div id="comments"><p>Reader</p></div><p>Body</p>'
    assert [x for x, _ in html.page_lines(f"<body><div class='site-header'>Top</div><article>{inner}</article></body>")] == ["Title", "Effects", "Work", "Body"]


def test_very_long_page():
    long = "<article>" + "<p>word &amp; word</p>" * 50000 + "</article>"
    assert len(html.page_lines(long)) == 50000


def test_differencing_of_pages_without_article(spark):
    def page(*lines):
        return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"

    rows = [
        (1, "http://h.org/a/1", page("Top", "First text", "Subscribe")),
        (2, "https://H.org/a/2.html", page("Top", "Second text", "Subscribe")),
        (3, "http://other.org/a/1", page("Top", "Third", "Subscribe")),
        (4, "http://copy.org/x/1", page("Same", "lines")),
        (5, "http://copy.org/x/2", page("Same", "lines")),
        (6, None, None),
        (7, "http://h.org/z", PAGE),
        (7, "http://h.org/z", PAGE),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("extra", F.col("page_id")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted((r["page_id"], r["text"], r["n_chars"], r["extra"]) for r in html.extract_text(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    main = "A & B One two threex Four five"
    assert [g[:2] for g in got] == [(1, "First text"), (2, "Second text"), (3, "Top Third Subscribe"), (4, "Same lines"), (5, "Same lines"), (6, ""), (7, main), (7, main)]
    assert all(n == len(t) and e == i for i, t, n, e in got)
    assert html.extract_text(df.limit(0)).count() == 0


def test_differencing_of_pages_with_article(spark):
    def page(i, kind="post"):
        return f"<body><p>Top</p><h1>Title {i}</h1><article class='{kind}'><p>Story {i}</p><p>Both say this</p></article><p>Subscribe</p></body>"

    rows = [(i, f"http://h.org/a/{i}", page(i)) for i in range(3)] + [(i, f"http://g.org/a/{i}", page(i, "related")) for i in range(3, 6)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = dict(html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: f"Title {i} Story {i}" + " Both say this" * (i < 3) for i in range(6)}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_copies_and_range_edges_keep_no_boilerplate(spark, parts):
    def page(*lines):
        return "<body>" + "".join(f"<p>{x}</p>" for x in ("Top", *lines, "Subscribe")) + "</body>"

    rows = [(i, f"http://h.org/a/{i:03}", page(f"Text {i}" if i % 10 == 0 else "Copied text")) for i in range(150)]
    rows += [(1000 + i, f"http://h.org/c/{i:03}", page("Large group")) for i in range(100)]
    rows += [(2000 + i, "http://same.org/", page(f"Own {i}")) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = dict(html.extract_text(df).select("page_id", "text").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 300
    for i, text in got.items():
        assert text == ("Large group" if 1000 <= i < 2000 else f"Own {i - 2000}" if i >= 2000 else f"Text {i}" if i % 10 == 0 else "Copied text")


def test_articles_of_the_pages(spark, small):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op8_html_extraction(spark, small).collect()}
    assert set(got) == set(pages)
    for i, h in pages.items():
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        assert got[i] == " ".join(unescape(re.sub(r"</?(?:p|h1|br)>", "\n", body).replace("<b>", "").replace("</b>", "")).split())


@pytest.mark.parametrize("seed", range(5))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = sorted(html.shared_lines(a, b))
    assert len(got) == table[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in got)


def _repeat_by_hand(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_quality_counts_by_hand(spark):
    rng = random.Random(1)
    texts = [t for t in ODD if t is None or len(t) < 1000] + [" ".join(rng.choice("ab") for _ in range(60)), "a b # $\n\na b # $\nx", "w " * 40 + "\n&|<"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit(None).cast("string"))
    for r in quality.judge(df, []).collect():
        t = texts[r["doc_id"]] or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == _repeat_by_hand(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
        assert r["kept"] == (not r["base_failed"])


def test_decision_list_on_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit_rules(docs, labels)
    assert rules and all(rule for rule in rules)
    judged = quality.judge(docs.select("doc_id", "text"), rules).join(labels, "doc_id")
    held = [r for r in judged.collect() if crc32(str(r["doc_id"]).encode()) % 5 == 0 and not r["base_failed"]]
    assert np.mean([r["kept"] == bool(r["quality"]) for r in held]) > 0.9
    assert quality.judge(docs.limit(0).select("doc_id", "text"), rules).count() == 0
    assert quality.fit_rules(docs, labels.limit(0)) == []


def test_mixing_meets_targets(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join((f"w{rng.randint(0, 99)}" + ("###" if bad else "")) for _ in range(rng.randint(20, 60)))))
        if i % 2 or i % 8 == 0:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "a b c")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, quality int")
    for targets in ({"1": 0.9, "0": 0.1}, {"1": 0.5, "0": 0.5}, {"1": 1.0}):
        got = mixing.mix(docs, lab, targets).collect()
        n = sum(r["n_tokens"] for r in got)
        totals = [sum(r["rate"] * r["n_tokens"] * r["posteriors"][k] for r in got) / n for k in (0, 1)]
        assert totals == pytest.approx([targets.get("0", 0.0), targets["1"]], abs=2e-3)
        assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got) and len(got) == 403
    assert {r["rate"] for r in mixing.mix(docs, lab.limit(0)).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), lab).count() == 0
    again = mixing.resample(docs.withColumn("extra", F.lit(1)), lab)
    assert again.columns == ["doc_id", "text", "extra"]


def test_domains_beyond_the_bound_and_clashing_columns(spark):
    lab = spark.range(1200).selectExpr("id as doc_id", "concat('d', id) as quality")
    docs = spark.createDataFrame([(1, "a b", 7, 0.5), (1, "a b", 7, 0.5), (2, None, 8, 0.25)], "doc_id long, text string, n_tokens int, rate double")
    with pytest.raises(ValueError, match="1000"):
        mixing.mix(docs, lab)
    got = mixing.resample(docs, lab.limit(0)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a b", 7, 0.5), (1, "a b", 7, 0.5), (2, None, 8, 0.25)], key=str)


def test_rates_equal_a_loop_by_hand(spark):
    rng = np.random.default_rng(3)
    steps = rng.normal(0, 0.4, (5, 2)).tolist()
    posteriors = [(p, 1 - p) for p in rng.random(50)]
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(posteriors)], "i long, posteriors array<double>")
    got = {r["i"]: r["rate"] for r in df.select("i", F.expr(mixing.rate_sql(steps)).alias("rate")).collect()}
    for i, p in enumerate(posteriors):
        rate = 1.0
        for s in steps:
            rate = max(0.0, rate - float(np.dot(p, s)))
        assert got[i] == pytest.approx(rate)


def test_rates_minimise_the_distance_to_the_targets(spark):
    rng = np.random.default_rng(4)
    p, n = rng.random(60), rng.integers(5, 50, 60)
    df = spark.createDataFrame([(int(t), [float(a), float(1 - a)]) for a, t in zip(p, n, strict=True)], "n_tokens long, posteriors array<double>")
    steps, off = mixing.fit_rates(df, [0.3, 0.7], most=60)
    found = df.select("n_tokens", "posteriors", F.expr(mixing.rate_sql(steps)).alias("rate")).collect()
    shares = [sum(r["rate"] * r["n_tokens"] * r["posteriors"][k] for r in found) / n.sum() for k in (0, 1)]
    assert off <= mixing.CLOSE and shares == pytest.approx([0.3, 0.7], abs=2 * mixing.CLOSE)


def test_rates_equal_projected_gradient_by_hand():
    steps = [[0.5, -0.2], [1.5, 0.0]]
    p, r = np.array([0.3, 0.7]), 1.0
    for s in steps:
        r = max(0.0, r - float(p @ s))
    assert mixing.rate_sql(steps).count("greatest") == 2 and r == pytest.approx(max(0.0, max(0.0, 1 - 0.01) - 0.45))


def test_ftrl_equals_the_update_by_hand():
    rng = np.random.default_rng(6)
    alpha, beta, l1, l2, size = 0.7, 1.3, 0.2, 0.05, 12
    model = toxicity.Ftrl(buckets=size, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    for _ in range(200):
        at, label = np.unique(rng.integers(0, size, 4)), int(rng.integers(0, 2))
        before = model.weights(np.arange(size + 1)).copy()
        model.learn(at, label)
        active = [*at.tolist(), size]
        p = 1 / (1 + math.exp(-sum(before[i] for i in active)))
        for i in active:
            g = p - label
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * before[i]
            n[i] += g * g
        after = model.weights(np.arange(size + 1))
        for i in range(size):
            want = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
            assert after[i] == pytest.approx(want, rel=1e-5, abs=1e-7)


def test_kept_equals_the_list_by_hand(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rules = [*quality.fit_rules(docs, labels), [("distinct_share", "<=", 0.4), ("exclaims_per_word", ">=", 0.0)]]

    def value(row, name):
        a, b = quality.FEATURES[name]
        return float(row[a]) if b is None else float(row[a]) / row[b] if row[b] > 0 else 0.0

    verdicts = set()
    for r in quality.judge(docs.select("doc_id", "text"), rules).collect():
        bad = any(all(value(r, name) >= cut if op == ">=" else value(r, name) <= cut for name, op, cut in rule) for rule in rules)
        assert r["kept"] == (not r["base_failed"] and not bad)
        verdicts.add((r["base_failed"], bad))
    assert len(verdicts) >= 3
