"""Ranked lexical search over posting lists in geometric blocks.

Documents are taken in shards of some thousand. In a shard every term has its posting
list, whose documents are clustered by similarity into blocks; a block stores the largest
impact of any of its documents for each term (its summary). The best a block can give an
item is the summed summary, an exact bound, so a block is opened only if that reaches the
score already known for the item's last place. Scores are 64-bit integers.

A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))) and its impact in a document
(10^9 tf) div (1000 tf + 20 m), with m = 50 + 50nN div L.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from demarca.llm.common import drop_stored, shared_folder, stored

#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased.
TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Documents of a shard and, as a mean, of a block.
SHARD, BLOCK = 2048, 32

#: Dimensions of the sketches that the documents of a list are compared by.
SKETCH = 16

#: One document in so many gives the scores that are known beforehand; they decide what is skipped, not the result.
SAMPLE = 16

#: Items that are searched for in one pass over the documents; more make more passes.
ITEMS = 256


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return raw.translate(TERMS).split()


@dataclass
class Queries:
    """Items as sets of term numbers, and the numbers of the terms."""

    numbers: dict[bytes, int]
    items: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        """The queries of some items' texts; a null one has no terms."""
        own = [sorted(set(terms((t or "").encode()))) for t in texts]
        numbers = {t: k for k, t in enumerate(sorted(set().union(*own)))}
        return cls(numbers, [np.array([numbers[t] for t in x], dtype=np.int64) for x in own])


@dataclass
class Corpus:
    """What weights and impacts depend on: documents with a term, all terms, and each query term's weight."""

    documents: int
    length: int
    weights: np.ndarray


def forward(docs: DataFrame, queries: Queries) -> DataFrame:
    """Rows (doc_id, n, terms, tf): a document's number of terms, and its query terms with their frequencies."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind, numbers = rows.schema["doc_id"].dataType.simpleString(), queries.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, own, counts = [], [], []
            for text in batch.column("text"):
                words = terms(text.as_py())
                size.append(len(words))
                found = sorted((numbers[w], c) for w, c in Counter(words).items() if w in numbers)
                own.append([k for k, _ in found])
                counts.append([c for _, c in found])
            arrays = [pa.array(size, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in (own, counts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n", "terms", "tf"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


def measured(rows: DataFrame, queries: Queries) -> Corpus:
    """The corpus statistics of all forward rows; one count per query term is gathered."""
    whole = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    documents = whole[0]
    df = [held.get(k, 0) for k in range(len(queries.numbers))]
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df]
    return Corpus(documents, max(whole[1], 1), np.array(weights, dtype=np.int64))


def sparse(batch: pa.RecordBatch, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of some forward rows, by row and term."""
    own = batch.column("terms")
    row = np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy())
    tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
    n = batch.column("n").to_numpy()
    m_rows, at = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * int(x) * corpus.documents // corpus.length for x in m_rows], dtype=np.int64)[at]
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
    return row, own.flatten().to_numpy().astype(np.int64), impact


def best(scores: np.ndarray, ids: list, least: int, k: int) -> list[tuple[int, int]]:
    """(place, score) of the ``k`` best scores of at least ``least``; equal ones by ascending id, null ids last."""
    at = np.flatnonzero(scores >= least)
    if len(at) > k:  # keep all that tie with the last place
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    order = sorted(at.tolist(), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))
    return [(i, int(scores[i])) for i in order[:k]]


def hits(found: list[tuple[int, object, int]], kind: pa.DataType) -> pa.RecordBatch:
    """Rows (item, doc_id, score)."""
    columns = zip(*found, strict=True) if found else ([], [], [])
    arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), kind, pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])


def known_scores(rows: DataFrame, queries: Queries, corpus: Corpus, k: int) -> np.ndarray:
    """A score per item that its k-th best document surely reaches: that of one document in ``SAMPLE``, at least 1."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, impact = sparse(batch, corpus)
            found = []
            for item, own in enumerate(queries.items):
                weight = np.zeros(len(queries.numbers), dtype=np.int64)
                weight[own] = corpus.weights[own]
                scores = np.bincount(row, impact * weight[term], minlength=batch.num_rows).astype(np.int64)
                found += [(item, None, s) for _, s in best(scores, [0] * batch.num_rows, 1, k)]
            yield hits(found, batch.schema.field("doc_id").type)

    some = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE)) == 0)
    scores = some.mapInArrow(run, f"item int, doc_id {kind}, score long")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    least = np.ones(len(queries.items), dtype=np.int64)
    for r in ranked.where(F.col("rank") == k).select("item", "score").collect():
        least[r.item] = max(1, r.score)
    return least


def needed(queries: Queries, peak: np.ndarray, least: np.ndarray) -> dict[int, list[int]]:
    """Items by the posting lists that they must look into.

    A document that has only an item's terms of the smallest peaks can't reach the least
    score while those peaks together don't, so their lists needn't be opened.
    """
    opened = defaultdict(list)
    for item, own in enumerate(queries.items):
        rising = own[np.argsort(peak[own], kind="stable")]
        for term in rising[np.cumsum(peak[rising]) >= least[item]].tolist():
            if peak[term]:
                opened[term].append(item)
    return opened


INDEX = "terms binary, starts binary, impacts binary, lists array<struct<term: int, docs: binary, blocks: binary, columns: binary, summary: binary>>"


def indexed(rows: DataFrame, queries: Queries, corpus: Corpus, least: np.ndarray) -> DataFrame:
    """One row per shard: its documents, their impacts, and its posting lists in blocks with summaries.

    A list is clustered around every 32nd of its documents, by the sketches of all their
    impacts; a cluster is a block. Lists and summary columns that no item can ask for
    under ``least`` are not built.
    """
    kind, size = rows.schema["doc_id"].dataType.simpleString(), len(queries.numbers)
    weights = corpus.weights

    def shard(batch: pa.RecordBatch, signs: np.ndarray) -> dict:
        row, term, impact = sparse(batch, corpus)
        dense = np.zeros((batch.num_rows, size), dtype=np.int32)
        dense[row, term] = impact
        sketch = (dense * weights.astype(np.float32)) @ signs
        sketch /= np.linalg.norm(sketch, axis=1, keepdims=True) + 1e-9
        lists = []
        for t, items in sorted(needed(queries, dense.max(axis=0).astype(np.int64) * weights, least).items()):
            own = np.flatnonzero(dense[:, t])
            label = (sketch[own] @ sketch[own[::BLOCK]].T).argmax(axis=1)
            order = np.argsort(label, kind="stable")
            own, label = own[order], label[order]
            blocks = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            columns = np.unique(np.concatenate([queries.items[i] for i in items]))
            summary = np.maximum.reduceat(dense[np.ix_(own, columns)], blocks, axis=0)
            arrays = {"docs": own, "blocks": blocks, "columns": columns, "summary": summary}
            lists.append({"term": t} | {k: x.astype("<i4").tobytes() for k, x in arrays.items()})
        starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        forward_arrays = {"terms": term, "starts": starts, "impacts": impact}
        return {k: x.astype("<i4").tobytes() for k, x in forward_arrays.items()} | {"lists": lists}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.random.default_rng(1).choice([-1.0, 1.0], (size, SKETCH)).astype(np.float32)
        lists = pa.list_(pa.struct([("term", pa.int32()), *((c, pa.binary()) for c in ("docs", "blocks", "columns", "summary"))]))
        for batch in shards(batches):
            made = shard(batch, signs)
            arrays = [pa.array([made[c]], pa.binary()) for c in ("terms", "starts", "impacts")]
            ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type))
            yield pa.RecordBatch.from_arrays(
                [ids, *arrays, pa.array([made["lists"]], lists)], names=["doc_ids", "terms", "starts", "impacts", "lists"]
            )

    return rows.mapInArrow(run, f"doc_ids array<{kind}>, {INDEX}")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows in batches of ``SHARD``, the last one smaller."""
    kept, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            kept.append(batch.slice(at, SHARD))
            count += kept[-1].num_rows
            while count >= SHARD:
                whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                yield whole.slice(0, SHARD)
                kept, count = [whole.slice(SHARD)], count - SHARD
    if count:
        yield pa.Table.from_batches([b for b in kept if b.num_rows]).combine_chunks().to_batches()[0]


def searched(index: DataFrame, queries: Queries, corpus: Corpus, least: np.ndarray, k: int) -> DataFrame:
    """Rows (item, doc_id, score): each shard's ``k`` best documents of every item that reach ``least``."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    weights, size = corpus.weights, len(queries.numbers)

    def read(data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype="<i4")

    def answers(ids: list, shard: dict) -> list[tuple[int, object, int]]:
        dense = np.zeros((len(ids), size), dtype=np.int32)
        dense[np.repeat(np.arange(len(ids)), np.diff(read(shard["starts"]))), read(shard["terms"])] = read(shard["impacts"])
        opened = {x["term"]: x for x in shard["lists"]}
        met = [np.zeros(len(ids), dtype=bool) for _ in queries.items]
        peak = dense.max(axis=0).astype(np.int64) * weights
        for term, items in needed(queries, peak, least).items():
            own = opened[term]
            docs, blocks, columns = read(own["docs"]), read(own["blocks"]), read(own["columns"])
            weight = np.zeros((len(columns), len(items)))  # all sums are whole numbers below 2^53
            for j, item in enumerate(items):
                asked = queries.items[item]
                weight[np.searchsorted(columns, asked), j] = weights[asked]
            bounds = read(own["summary"]).reshape(len(blocks), -1).astype(np.float64) @ weight
            length = np.diff(np.r_[blocks, len(docs)])
            for j, item in enumerate(items):
                reached = bounds[:, j] >= least[item]
                if reached.any():
                    met[item][docs[np.repeat(reached, length)]] = True
        found = []
        for item, asked in enumerate(queries.items):
            at = np.flatnonzero(met[item])
            if len(at):
                scores = dense[np.ix_(at, asked)].astype(np.float64) @ weights[asked].astype(np.float64)
                own = [ids[i] for i in at]
                found += [(item, own[i], s) for i, s in best(scores.astype(np.int64), own, int(least[item]), k)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard = batch.slice(at, 1).to_pylist()[0]
                yield hits(answers(shard.pop("doc_ids"), shard), batch.schema.field("doc_ids").type.value_type)

    return index.mapInArrow(run, f"item int, doc_id {kind}, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Every row of ``docs`` is a document, repeats and null ids included; null and wordless
    texts are documents that no item finds. Equal scores go by ascending id, null ids last.
    Repeated rows of ``items`` are one item; null and wordless ones find nothing, as do all
    in an empty table. Other columns are not read.

    Items are taken in blocks of 256; the terms of a block go to every task, so their
    number is bounded by the items' texts, not by the documents. Of each block's steps only
    the hits stay in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).distinct()
    item_kind, doc_kind = (df.schema[0].dataType.simpleString() for df in (asked, docs))
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    block: list[Row] = []
    waiting = asked.orderBy("item_id", "text").toLocalIterator()
    while block := [r for _, r in zip(range(ITEMS), waiting, strict=False)]:
        queries = Queries.of([r.text for r in block])
        if not queries.numbers:
            continue
        paths = [shared_folder(spark) for _ in range(2)]
        rows = stored(forward(docs, queries), path=paths[0])
        corpus = measured(rows, queries)
        least = known_scores(rows, queries, corpus, k)
        index = stored(indexed(rows, queries, corpus, least), path=paths[1])
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = searched(index, queries, corpus, least, k).withColumn("rank", F.row_number().over(order))
        found = stored(found.where(F.col("rank") <= k))
        for path in paths:
            drop_stored(spark, path)
        ids = F.array(*[F.lit(r.item_id).cast(item_kind) for r in block])
        out = out.unionByName(found.select(F.get(ids, "item").alias("item_id"), "rank", "doc_id", "score"))
    return out
