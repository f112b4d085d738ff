"""Suffix-array dedup of byte strings that occur more than once.

Every window of ``SPAN`` bytes has an anchor: the k-gram in it with the least hash. Equal
windows have equal anchors in the same place, so a window needs comparing only with those
of its anchor, and windows in a row with one anchor, a region, are handled together.
Regions are dealt by anchor into shards. A shard is one text, its suffix array is built by
Larsson-Sadakane refinement and its common prefixes by the permuted form of Kasai's
recurrence, both in numpy. An anchor with very many different regions is split over
shards; what each of them finds only once is merged across shards by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import keyed, partitions, same_document, stored

#: Bytes of a string that must not occur twice.
SPAN = 400

#: Bytes of a k-gram.
GRAM = 32

#: Low bits of a packed hash that hold a place; a longer text is read in overlapping pieces.
PLACE = 23

#: Different regions of one anchor that stay in one shard; it decides how work is dealt, not what is found.
SPLIT = 512

#: Strings that are merged across shards together, about; there is a bucket of digests for every so many.
BUCKET = 1 << 21

#: Bytes that a shard's suffix array is built over, about and at most; whole groups stay together.
SHARD_BYTES, MOST_BYTES = 1 << 20, (1 << 21) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all k-grams of a byte array."""
    word = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    for width in (8, 16):
        word = (word ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        word = word[:-width] * np.uint64(0xD6E8FEB86659FD93) + word[width:]
    word = (word ^ (word >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return word ^ (word >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values, from block-wise running minima."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    blocks = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def regions(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor place, anchor hash) of all windows of texts laid end to end.

    ``stops`` are the places after each text's last byte. Windows in a row with one anchor
    are one region; no window crosses a stop.
    """
    found, piece = [], 1 << (PLACE - 1)
    for base in range(0, max(len(data) - SPAN + 1, 0), piece):
        part = data[base : base + piece + SPAN - 1]
        hashes = gram_hashes(part)
        low = np.uint64((1 << PLACE) - 1)
        packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least(packed, SPAN - GRAM + 1)
        starts = base + np.arange(len(least))
        whole = starts + SPAN <= stops[np.searchsorted(stops, starts, side="right")]
        first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
        count = np.diff(np.r_[first, len(least)])
        first, count = first[whole[first]], count[whole[first]]
        place = (least[first] & low).astype(np.int64)
        found.append((base + first, count, base + place, hashes[place].view(np.int64)))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(4))


REGION = "start int, windows int, anchor long, digest_a long, digest_b long"
KEYS = ["doc_id", "text_key"]
CONTENT = ["anchor", "digest_a", "digest_b"]


def region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of texts: start, windows, the anchor's hash and a 128-bit digest of its place and the bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            coded = [t.encode() for t in part.column("text").to_pylist()]
            joined = b"".join(coded)
            stops = np.cumsum([len(c) for c in coded])
            start, windows, place, anchor = regions(np.frombuffer(joined, dtype=np.uint8), stops)
            spans = zip(start.tolist(), (start + windows + SPAN - 1).tolist(), (place - start).tolist(), strict=True)
            digests = b"".join([xxhash.xxh3_128_digest(joined[a:b], lead) for a, b, lead in spans])
            digest = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
            row = np.searchsorted(stops, start, side="right")
            begin = np.r_[0, stops[:-1]][row]
            keys = [part.column(c).take(pa.array(row)) for c in KEYS]
            numbers = [pa.array((start - begin).astype(np.int32)), pa.array(windows.astype(np.int32))]
            hashes = [pa.array(np.ascontiguousarray(x)) for x in (anchor, digest[:, 0], digest[:, 1])]
            yield pa.RecordBatch.from_arrays([*keys, *numbers, *hashes], names=[*KEYS, "start", "windows", *CONTENT])


#: Ends a region in a shard's text; no UTF-8 text has this byte. Every one counts as a letter of its own.
STOP = 255

#: Bits of a place in a shard: a group, a rank and a place are sorted as one number.
BITS = np.uint64(21)
LOW = np.uint64((1 << 21) - 1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement; ``text`` ends with a stop and has fewer than 2^21 bytes.

    Suffixes are sorted by five bytes. Then every group of equals is sorted by the ranks
    of what follows, doubling the compared length; groups of one are finished and rest.
    """
    n = len(text)
    if n > MOST_BYTES:
        raise ValueError(f"a shard of {n} bytes")
    places = np.arange(n, dtype=np.uint64)
    padded = np.r_[text, np.zeros(4, np.uint8)]
    key, open_ = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(5):  # what comes after a stop doesn't count
        byte = padded[k : k + n]
        key = (key << np.uint64(8)) | np.where(open_, byte, 0).astype(np.uint64)
        open_ &= byte != STOP
    packed = np.sort((key << BITS) | places)
    order = (packed & LOW).astype(np.int64)
    first = np.r_[True, packed[1:] >> BITS != packed[:-1] >> BITS] | ~open_[order]
    first[1:] |= ~open_[order[:-1]]
    rank = np.empty(n, dtype=np.uint64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    slots = slots[~(first & np.r_[first[1:], True])]
    length = 5
    while len(slots):
        i = order[slots]
        packed = np.sort((rank[i] << (BITS + BITS)) | (rank[i + length] << BITS) | i.astype(np.uint64))
        i = (packed & LOW).astype(np.int64)
        order[slots] = i
        both = packed >> BITS
        first = np.r_[True, both[1:] != both[:-1]]
        rank[i] = slots[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
        slots = slots[~(first & np.r_[first[1:], True])]
        length *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, by Kasai's recurrence.

    In text order a value is one less than the value before it, except where the letters
    before the two suffixes differ; only those values are found by comparing, eight bytes
    at a time, and the others are filled in.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    left = np.r_[STOP, text[:-1]]
    known = np.flatnonzero((before <= 0) | (left == STOP) | (left != left[before]))
    ends = np.flatnonzero(text == STOP)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    words = np.ndarray((n,), dtype="<u8", buffer=np.r_[text, np.zeros(8, np.uint8)], strides=(1,))
    a, b = known, before[known]
    limit = np.where(b < 0, 0, np.minimum(room[a], room[b]))
    size, open_ = np.zeros(len(a), dtype=np.int64), np.flatnonzero(limit > 0)
    while len(open_):
        at = size[open_]
        differ = words[a[open_] + at] ^ words[b[open_] + at]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(float)).astype(np.int64)) // 8)
        size[open_] = at + same
        open_ = open_[(same == 8) & (size[open_] < limit[open_])]
    reach = np.zeros(n, dtype=np.int64)
    reach[known] = np.minimum(size, limit) + known
    last = np.zeros(n, dtype=np.int64)
    last[known] = known
    return (reach[np.maximum.accumulate(last)] - np.arange(n))[order]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of set flags begin and end."""
    edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


FOUND = "anchor long, digest_a long, digest_b long, spans array<struct<first:int,stop:int>>, bucket int, pack binary"
FOUND_TYPE = pa.schema(
    [
        *[(c, pa.int64()) for c in CONTENT],
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))),
        ("bucket", pa.int32()),
        ("pack", pa.binary()),
    ]
)

#: A string that is to be merged across shards: its digest, its place (-1 if its shard found it twice) and its region.
STRING = np.dtype([("a", "<i8"), ("b", "<i8"), ("at", "<i4"), ("anchor", "<i8"), ("digest_a", "<i8"), ("digest_b", "<i8")])


def shard(rows: list[dict], buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of the regions ``rows`` that occur twice or more among them, copies of a region included.

    An interval of the suffix array whose common prefixes reach ``SPAN`` is one string. Only
    windows are counted, each once, not what overlaps into a region from its neighbours.
    Of the regions of a split anchor, the strings to be merged across shards follow in packs,
    one per bucket of their digests: windows found once, and one of each found more often.
    """
    text = np.frombuffer(b"".join([x for r in rows for x in (r["bytes"], b"\xff")]), dtype=np.uint8)
    size = np.array([len(r["bytes"]) + 1 for r in rows])
    start = np.cumsum(size) - size
    weight, owner = np.zeros(len(text)), np.repeat(np.arange(len(rows)), size)
    for r, s in zip(rows, start.tolist(), strict=True):
        weight[s : s + r["windows"]] = r["copies"]
    order = suffix_array(text)
    group = np.cumsum(common_prefixes(text, order) < SPAN)
    total = np.bincount(group, weights=weight[order])
    of = np.empty(len(text), dtype=np.int64)
    of[order] = group
    again = (weight > 0) & (total[of] >= 2)
    spans = []
    for r, s in zip(rows, start.tolist(), strict=True):
        first, stop = runs(again[s : s + r["windows"]])
        spans.append([{"first": a, "stop": b} for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    names = [[r[c] for r in rows] for c in CONTENT]
    columns = [*names, spans, [None] * len(rows), [None] * len(rows)]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_TYPE, strict=True)], schema=FOUND_TYPE)

    split = np.array([r["split"] for r in rows])
    counted = np.flatnonzero((weight > 0) & split[owner])
    _, one = np.unique(of[counted], return_index=True)
    at = counted[one]
    if not len(at):
        return
    data, strings = text.tobytes(), np.empty(len(at), dtype=STRING)
    digests = b"".join([xxhash.xxh3_128_digest(data[p : p + SPAN]) for p in at.tolist()])
    strings["a"], strings["b"] = np.frombuffer(digests, dtype="<i8").reshape(-1, 2).T
    strings["at"] = np.where(again[at], -1, at - start[owner[at]])
    for c, values in zip(CONTENT, names, strict=True):
        strings[c] = np.array(values, dtype=np.int64)[owner[at]]
    bucket = (strings["a"].view("<u8") % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    packs = np.split(strings[order], cuts)
    none = [None] * len(packs)
    columns = [none, none, none, none, bucket[order][np.r_[0, cuts]].tolist(), [p.tobytes() for p in packs]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_TYPE, strict=True)], schema=FOUND_TYPE)


def shards(buckets: int):
    """Cut a partition, sorted by (anchor, part), into shards of whole groups and search each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, group, group_bytes, name = [], 0, [], 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for r in batch.slice(at, 512).to_pylist():
                    if (r["anchor"], r["part"]) != name:
                        held, held_bytes = held + group, held_bytes + group_bytes
                        if held_bytes >= SHARD_BYTES:
                            yield from shard(held, buckets)
                            held, held_bytes = [], 0
                        group, group_bytes, name = [], 0, (r["anchor"], r["part"])
                    if held and held_bytes + group_bytes + len(r["bytes"]) + 1 >= MOST_BYTES:
                        yield from shard(held, buckets)
                        held, held_bytes = [], 0
                    group.append(r)
                    group_bytes += len(r["bytes"]) + 1
        if held or group:
            yield from shard(held + group, buckets)

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of several shards: search each shard's strings in the sorted strings of all of them.

    Rows are packs sorted by bucket, in which a shard's string comes once; one bucket is held.
    """

    def found(packs: list[bytes]) -> pa.RecordBatch:
        strings = np.frombuffer(b"".join(packs), dtype=STRING)
        code = np.unique(strings["a"], return_inverse=True)[1]
        pair = np.unique(np.stack([code, strings["b"]]), axis=1, return_inverse=True)[1].ravel()
        every = np.sort(pair)
        count = np.searchsorted(every, pair, side="right") - np.searchsorted(every, pair, side="left")
        kept = strings[(count >= 2) & (strings["at"] >= 0)]
        names = [*CONTENT, "at"]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kept[c])) for c in names], names=names)

    now, packs = None, []
    for batch in batches:
        for bucket, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            if bucket != now and packs:
                yield found(packs)
                packs = []
            now = bucket
            packs.append(pack)
    if packs:
        yield found(packs)


def repeated_regions(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, first, stop): bytes covered by windows that occur twice or more, by region."""
    spark = texts.sparkSession
    n = partitions(spark)
    kind = texts.schema["doc_id"].dataType.simpleString()
    all_regions = stored(texts.mapInArrow(region_rows, f"doc_id {kind}, text_key long, {REGION}"))
    rep = F.min(F.struct("doc_id", "text_key", "start")).alias("rep")
    different = all_regions.groupBy(*CONTENT).agg(F.count("*").alias("copies"), F.min("windows").alias("windows"), rep)
    different = stored(different)
    of_anchor = different.groupBy("anchor").agg(
        F.count("*").alias("different"), F.sum("copies").alias("total"), F.min("copies").alias("rarest")
    )
    met = stored(different.join(of_anchor.where("total > 1"), "anchor"))
    part = F.when(F.col("different") > SPLIT, F.pmod("digest_a", F.ceil(F.col("different") / SPLIT))).otherwise(0)
    searched = met.where("different > 1 AND rarest = 1").select(
        *CONTENT, "copies", "windows", "rep.*", part.cast("long").alias("part"), (F.col("different") > SPLIT).alias("split")
    )
    data = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("windows") + (SPAN - 1)).alias("bytes")
    cut = same_document(searched, texts).select(*CONTENT, "copies", "windows", "part", "split", data)
    buckets = max(n, searched.where("split").count() * (SPAN - GRAM + 1) // BUCKET)
    dealt = cut.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part")
    found = stored(dealt.mapInArrow(shards(buckets), FOUND))
    packs = found.where("bucket IS NOT NULL").select("bucket", "pack").repartition(n, "bucket").sortWithinPartitions("bucket")
    across = packs.mapInArrow(merged, "anchor long, digest_a long, digest_b long, at int")
    single = F.struct(F.col("at").alias("first"), (F.col("at") + 1).alias("stop")).alias("span")
    whole = met.where("copies > 1").select(*CONTENT, F.struct(F.lit(0).alias("first"), F.col("windows").alias("stop")).alias("span"))
    within = found.where("bucket IS NULL").select(*CONTENT, F.explode("spans").alias("span"))
    spans = within.unionByName(across.select(*CONTENT, single))
    spans = spans.unionByName(whole).groupBy(*CONTENT).agg(F.collect_list("span").alias("spans"))  # of one region
    spans = stored(spans)  # so that a region with very many copies can be split in the join
    back = all_regions.join(spans, CONTENT).select(*KEYS, "start", F.explode("spans").alias("span"))
    return back.select(
        *KEYS, (F.col("start") + F.col("span.first")).alias("first"), (F.col("start") + F.col("span.stop") + (SPAN - 1)).alias("stop")
    )


def cut_spans(data: bytes, found: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal spans that are removed."""
    spans: list[list[int]] = []
    for x in sorted((f["first"], f["stop"]) for f in found):
        if spans and x[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], x[1])
        else:
            spans.append(list(x))
    edges = [0, *[p for s in spans for p in s], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), [tuple(s) for s in spans]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, kept binary, spans): texts without the strings of ``SPAN`` bytes that occur twice.

    Texts are UTF-8 bytes; every byte of a string that also starts anywhere else, in the
    same document or another, goes from all its places, judged on the input. ``spans`` are
    the maximal removed runs (first byte, byte after the last); ``kept`` is what is left,
    which need not be valid text. A null text counts as empty; texts shorter than the span
    lose nothing; rows repeated in id and text count as rows, so they lose what they share;
    null ids are ids; an empty table gives no rows.
    """
    rows = keyed(docs, doc_id, text)
    found = repeated_regions(rows).groupBy(*KEYS).agg(F.collect_set(F.struct("first", "stop")).alias("found"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = [t.encode() for t in part.column("text").to_pylist()]
                done = [cut_spans(d, f or []) for d, f in zip(data, part.column("found").to_pylist(), strict=True)]
                spans = [[{"first": a, "stop": b} for a, b in s] for _, s in done]
                span = pa.struct([("first", pa.int32()), ("stop", pa.int32())])
                columns = [
                    part.column("doc_id"),
                    pa.array([len(d) for d in data], pa.int64()),
                    pa.array([k for k, _ in done], pa.binary()),
                    pa.array(spans, pa.list_(span)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "kept", "spans"])

    met = same_document(rows, found, "left").select("doc_id", "text", "found")
    return met.mapInArrow(cut, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<first:int,stop:int>>")
