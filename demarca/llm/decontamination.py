"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a mask over eight words: five count, the others are ignored. Seeds of all test
items and of all training positions are hashed and joined; around every hit the item is
laid over the document word by word, and a window with enough equal words is an overlap.
"""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import keyed, let, same_document, stored, words

#: Positions that count. Chosen by exhaustive search: for every window of 8 to 20 words in
#: which at least 80 % are equal, some mask meets equal words only, wherever the others are.
MASKS = [(0, 3, 4, 5, 7), (0, 1, 2, 3, 5), (0, 2, 5, 6, 7)]

#: Items of fewer words are met by masks of their own length.
LEAST_WORDS = 8

#: Words of a window; shorter items are compared whole.
WINDOW = 20

#: Test seeds up to this number (about 10 MB) go to every task; more are joined by shuffle.
FEW_SEEDS = 200_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words."""
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


#: A mask, the words it spans, and a number that tells its seeds from others'.
Mask = tuple[tuple[int, ...], int, int]

LONG_MASKS: list[Mask] = [(m, m[-1] + 1, k) for k, m in enumerate(MASKS)]


def short_masks(n_words: int, similarity: float) -> list[Mask]:
    """Masks for items of so many words: every choice of the words that must be equal, from its first to its last.

    So an item is also met where its other words would stand before or behind the text.
    """
    need = max(1, math.ceil(Decimal(n_words) * Decimal(f"{similarity}")))
    made = sorted({tuple(p - m[0] for p in m) for m in combinations(range(n_words), need)})
    return [(m, m[-1] + 1, 100 * n_words + k) for k, m in enumerate(made)]


def spots(rows: DataFrame, keep: list[str], masks: list[Mask]) -> DataFrame:
    """``keep`` plus ``at`` and ``seed``: hashes of all masks laid at all places of ``hashes``.

    A text's seeds are one array of numbers, mask after mask, so nothing but ``keep`` is
    copied to a place; the place follows from the lengths.
    """
    counts = [F.greatest(F.col("n") - (span - 1), F.lit(0)) for _, span, _ in masks]

    def one(h: Column, mask: tuple[int, ...], span: int, k: int) -> Column:
        def seed(i: Column) -> Column:
            return F.xxhash64(F.lit(k), *[h[i + p] for p in mask])

        places = F.sequence(F.lit(0), F.size(h) - span)
        return F.when(F.size(h) >= span, F.transform(places, seed)).otherwise(F.array().cast("array<long>"))

    def laid(h: Column) -> Column:
        return F.concat(*[one(h, *mask) for mask in masks])

    rows = rows.select(*keep, F.size("hashes").alias("n"), let(F.col("hashes"), laid).alias("seeds"))
    rows = rows.select(*keep, "n", F.posexplode("seeds").alias("spot", "seed"))
    place, before = F.col("spot"), F.lit(0)
    for count in counts[:-1]:
        before = before + count
        place = F.when(F.col("spot") >= before, F.col("spot") - before).otherwise(place)
    return rows.select(*keep, place.alias("at"), "seed")


def best_window(item: Column, text: Column, shift: Column) -> Column:
    """Most equal words in any window of the item laid over the text ``shift`` words in."""
    size = F.least(F.size(item), F.lit(WINDOW))

    def windows(equal: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(item) - size + 1)
        add = lambda a, b: a + b
        return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(equal, s, size), F.lit(0), add)))

    def equal(w: Column, i: Column) -> Column:
        place = shift + i
        other = F.when(place >= 0, F.get(text, place))
        return F.coalesce(w == other, F.lit(False)).cast("int")

    return let(F.transform(item, equal), windows)


def overlaps(
    docs: DataFrame, items: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, text_key, item_id, matched, window, word_at): documents that hold a test item.

    A document holds an item if some window of it (20 words, or the whole of a shorter
    item) recurs with at least ``similarity`` of its words equal in place; for 0.8 or more
    the masks lose no such window. ``matched`` is the best window's count of equal words,
    ``word_at`` the first word at which such an item would start (it may be negative). One
    row per document and item; an item of fewer than eight words counts wherever as much of it
    stands, be it one word. Null or empty texts and empty tables give none, rows repeated in id and text count once, a null id is an id.
    Items repeated with one id are compared each.

    The test side's seeds go to every task if there are at most ``FEW_SEEDS``, else both
    sides are shuffled by seed. Distinct hits, not texts, come out of the join; texts meet
    their hits again by document.
    """
    tests = items.select("item_id", word_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)
    tests = tests.distinct().withColumn("item_key", F.xxhash64("hashes"))
    own, n_words = ["item_id", "item_key"], F.size("hashes")
    masks, marks = LONG_MASKS, spots(tests.where(n_words >= LEAST_WORDS), own, LONG_MASKS)
    for (n,) in sorted(tests.where(n_words < LEAST_WORDS).select(n_words).distinct().collect()):
        short = short_masks(n, similarity)
        masks, marks = masks + short, marks.unionByName(spots(tests.where(n_words == n), own, short))
    marks = marks.withColumnRenamed("at", "item_at")
    if marks.limit(FEW_SEEDS + 1).count() <= FEW_SEEDS:
        marks = F.broadcast(marks)
    texts = keyed(docs, doc_id, text)
    hashed = texts.select("doc_id", "text_key", word_hashes(F.col("text")).alias("hashes"))
    hits = spots(hashed, ["doc_id", "text_key"], masks).join(marks, "seed")
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    hits = stored(hits.select("doc_id", "text_key", "item_id", "item_key", shift).distinct())
    tests = tests.select("item_id", "item_key", F.col("hashes").alias("item"))
    hit = F.struct("item_id", "item", "shift")
    hits = hits.join(tests, ["item_id", "item_key"]).groupBy("doc_id", "text_key").agg(F.collect_list(hit).alias("hits"))

    def verified(hashes: Column) -> Column:
        def one(x: Column) -> Column:
            matched = best_window(x["item"], hashes, x["shift"])
            size = F.least(F.size(x["item"]), F.lit(WINDOW))
            return F.struct(x["item_id"].alias("item_id"), matched.alias("matched"), size.alias("window"), x["shift"].alias("word_at"))

        enough = F.lit(f"{similarity}").cast("decimal(6,4)")
        return F.filter(F.transform("hits", one), lambda x: x["matched"] >= F.ceil(x["window"] * enough))

    met = same_document(hits, texts)  # the hits of a document in one row, so its words are hashed once
    found = met.select("doc_id", "text_key", F.inline(let(word_hashes(F.col("text")), verified)))
    best = F.max(F.struct("matched", "window", (-F.col("word_at")).alias("before"))).alias("best")
    return (
        found.groupBy("doc_id", "text_key", "item_id")
        .agg(best)
        .select("doc_id", "text_key", "item_id", "best.matched", "best.window", (-F.col("best.before")).alias("word_at"))
    )


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their own columns."""
    found = overlaps(docs, items, similarity).select("doc_id", "text_key").distinct()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), own)
    return same_document(rows, found, "left_anti").select("own.*")
