"""Clustering, URL verdicts and ranked search against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from demarca.llm import centroids, ranked_search, url_filter
from demarca.llm.queries import ALLOWED, BLOCKED, QUERIES

SMALL = "/root/testdata/sf0.001"


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_clusters(rows, k, rounds, dims, scale):
    """Clusters and distances of (id, vector) rows, and the centroids, by whole distance matrices."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]
    for turn in range(rounds + 1):
        found = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
            found.append((i, d.index(min(d)), min(d)))
        if turn < rounds:
            groups = [[v for (_, v), f in zip(kept, found, strict=True) if f[1] == c] for c in range(len(centers))]
            centers = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for c, g in zip(centers, groups, strict=True)]
    return sorted(found, key=repr), centers


VECTOR = "vec_id long, embedding array<double>, cluster string, v int"


@pytest.mark.parametrize("size", [1.0, 1e7, 1e30])
def test_clusters_equal_brute_force(spark, size):
    """Small components, components beyond exact doubles, and distances beyond 64 bits."""
    rng = random.Random(3)
    centers = [[rng.uniform(-size, size) for _ in range(4)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, size / 20) for x in rng.choice(centers)]) for i in range(120)]
    rows += [(7, rows[7][1]), (None, [0.0, -0.0, 1e-300, 0.5]), (None, rows[3][1]), (500, [1.0]), (501, None), (502, [])]
    rows += [(503, [1.0, None, 1.0, 1.0]), (504, [math.nan, 1.0, 1.0, 1.0]), (505, [math.inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], VECTOR).repartition(3)
    got = centroids.clustered(df, k=6, rounds=3, dims=4)
    want, centers = brute_clusters(rows, 6, 3, 4, 64)
    assert got.centroids == centers
    assert by_row(got.rows) == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in want), key=repr)
    assert got.sizes == [sum(c == n for _, c, _ in want) for n in range(6)]
    assert got.inertias == [sum(d for _, c, d in want if c == n) for n in range(6)]


def test_clusters_of_one_vector_and_of_none(spark):
    """Equal vectors tie on the smaller number and leave the other centroids where they are."""
    df = spark.createDataFrame([(i, [1.0, 2.0], "", 0) for i in range(9)], VECTOR)
    got = centroids.clustered(df, k=4, dims=2)
    assert by_row(got.rows) == [(i, 0, 0) for i in range(9)]
    assert got.centroids == [[64, 128]] * 4 and got.sizes == [9, 0, 0, 0]
    none = centroids.clustered(df.limit(0), k=4, dims=2)
    assert none.rows.columns == ["vec_id", "cluster", "distance"] and none.rows.count() == 0
    assert QUERIES["op11_centroid_clusters"](spark, SMALL).columns[-1] == "centroid_sha256"


URLS = [
    (1, "https://WWW.Example.ORG/es/1?x=/a#y"),
    (2, "http://example.org/en/1234"),
    (3, "http://badexample.org/es/1"),
    (4, "http://org/x"),
    (5, "https://shop.example.com/de/"),
    (6, "https://shop.example.com/DE/"),
    (7, "https://example.org"),
    (8, "https://example.org?a://b/c"),
    (9, "no scheme"),
    (10, ""),
    (11, None),
    (None, "ftp://a.b:80/fr/é\U0001f600://x/y"),
    (12, "x://"),
    (13, "https://a.com/fr/" + "long/" * 30_000),
    (5, "https://shop.example.com/de/"),
]


def brute_rule(host, path):
    rules = [(h, p) for h, p in ALLOWED + BLOCKED if (f".{host}").endswith(f".{h}") and path.startswith(p)]
    return max(rules, key=lambda r: len(r[0] + r[1])) if rules else None


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.trained(spark.createDataFrame(url_filter.sample_urls(), "url string, blocked int"))


def test_verdicts(spark, model):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumns({"host": F.lit("clash"), "score": F.lit(1)})
    got = [tuple(r) for r in url_filter.judged(pages, ALLOWED, BLOCKED, model).collect()]
    assert len(got) == len(URLS)
    for (i, url), (page, host, path, rule, verdict, score) in zip(URLS, got, strict=True):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        rest = re.split(r"[?#]", rest)[0]
        want = rest.split("/", 1)
        assert (page, host.lower(), path) == (i, want[0].lower(), f"/{want[1]}" if len(want) > 1 else "")
        found = brute_rule(host, path)
        assert rule == (found and "".join(found)) and 0 <= score <= 1
        blocked = found in BLOCKED if found else score > 0.5
        assert verdict == ("block" if blocked else "allow")
    assert url_filter.judged(pages.limit(0), ALLOWED, BLOCKED, model).count() == 0
    with pytest.raises(ValueError, match="allow and block"):
        url_filter.judged(pages, ALLOWED, ALLOWED, model)


def test_scores_do_not_depend_on_the_batch(model):
    """Each URL alone gives the score it has among others; an empty one has the bias alone."""
    hosts, paths = ["a.example.com", "", "bets.example.com", "a.example.com"], ["/x/1", "", "", "/x/1"]
    together = model.scores(hosts, paths)
    alone = [model.scores([h], [p])[0] for h, p in zip(hosts, paths, strict=True)]
    assert np.allclose(together, alone) and together[0] == together[3]
    assert math.isclose(together[1], 1 / (1 + math.exp(-model.bias)))
    assert len(model.scores([], [])) == 0


def test_grams_are_counted(model):
    """One row's buckets hold its n-grams with their counts, scaled to length one."""
    row, bucket, share = url_filter.grams(["aaaaaaaa"], [""])
    assert set(row) == {0} and math.isclose(float((share**2).sum()), 1)
    assert len(bucket) < sum(len("\x01aaaaaaaa\x02\x03") - n + 1 for n in url_filter.GRAMS)


def test_model_on_held_out_sites(spark, model):
    """Sites of the pages: none of their names is in the labelled table; accuracy by page."""
    names = {urlsplit(u).hostname for u, _ in url_filter.sample_urls()}
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_filter.judged(pages, [], [], model).select("host", "score").collect()
    assert not {r.host for r in rows} & names
    unwanted = re.compile(r"(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.")
    right = sum((r.score > 0.5) == bool(unwanted.search(r.host)) for r in rows)
    caught = [r.score > 0.5 for r in rows if unwanted.search(r.host)]
    assert right >= 0.97 * len(rows) and sum(caught) >= 0.95 * len(caught) > 0


def test_training_on_little(spark):
    kind = "url string, blocked int"
    one = url_filter.trained(spark.createDataFrame([("http://a.b/", 1), (None, 0), ("http://c.d/", None)], kind))
    none = url_filter.trained(spark.createDataFrame([], kind))
    assert not one.weights.any() and not none.weights.any() and none.scores(["a"], ["/"])[0] < 0.5
    both = [("http://aaaa.com/", 1), ("http://aaaa.com/", 1), ("http://bbbb.com/", 0)]
    assert url_filter.trained(spark.createDataFrame(both, kind)).scores(["aaaa.com", "bbbb.com"], ["/", "/"]).argmax() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranked(docs, items, k):
    own = [(i, Counter(brute_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    out = []
    for item, text in set(items):
        scores = []
        for (doc, counts), n in zip(own, sizes, strict=True):
            score = 0
            for t in set(brute_terms(text)):
                df = sum(t in c for _, c in own)
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m = 100 - 50 + 50 * n * n_docs // total
                    score += w * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made_docs():
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)] + ["Ünï", "中文", "ß", "x1"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (n + 1) for n in range(len(words))], k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # a tie of 41
    docs += [(None, docs[6][1]), (6, docs[6][1]), (400, None), (401, ""), (402, " .,-\t\n"), (403, "A-b_C\x00d\x7fE É é"), (404, "w1 " * 30_000)]
    items = [(1, "w1 w2, W3; w50"), (2, docs[5][1]), (2, docs[5][1]), (3, None), (4, ""), (5, "unknown terms"), (6, "é É a"), (None, "w1"), (7, "w0")]
    return docs, items + [(10 + i, " ".join(rng.sample(words, 8))) for i in range(30)]


@pytest.mark.parametrize(("shard", "k"), [(2048, 50), (64, 3), (7, 10)])
def test_ranked_equals_brute_force(spark, monkeypatch, shard, k):
    """One shard or many, items of several passes, ties over the last rank."""
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "ITEMS", 16 if k == 3 else 256)
    docs, items = made_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df = df.withColumns({"n": F.lit("clash"), "item_id": F.lit(1)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert by_row(ranked_search.ranked(df, asked.select("item_id", "text", "doc_id"), k)) == brute_ranked(docs, items, k)


def test_ranked_without_documents_or_items(spark):
    docs, items = made_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for d, a in ((df.limit(0), asked), (df, asked.limit(0)), (df.where("text is null"), asked)):
        got = ranked_search.ranked(d, a)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_skipped_blocks_hold_no_hit(spark):
    """With a least score known, some blocks and lists are left unopened, and the hits stay the same."""
    docs, items = made_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    queries = ranked_search.Queries.of([t for _, t in items])
    rows = ranked_search.forward(df, queries).cache()
    corpus = ranked_search.measured(rows, queries)
    nothing = np.ones(len(queries.items), dtype=np.int64)
    whole = ranked_search.indexed(rows, queries, corpus, nothing)
    hits = [tuple(r) for r in ranked_search.searched(whole, queries, corpus, nothing, 5).collect()]
    least = nothing.copy()
    for item in range(len(least)):
        scores = sorted(s for i, _, s in hits if i == item)
        least[item] = scores[0] if len(scores) == 5 else 1
    pruned = ranked_search.indexed(rows, queries, corpus, least)
    again = [tuple(r) for r in ranked_search.searched(pruned, queries, corpus, least, 5).collect()]
    assert again == hits
    size = [x.agg(F.sum(F.aggregate("lists", F.lit(0), lambda a, b: a + F.length(b.summary)))).first()[0] for x in (whole, pruned)]
    assert size[1] < size[0]
