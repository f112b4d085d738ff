"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within three bits meet halfway. Both emit their variants within one bit,
half the radius rounded down, and the odd bit is taken out by erasing a third of the
positions: whatever three bits differ, some third can be erased so that at most two
differ outside it, or none (all three in one third). Equal variants are shuffled
together, and colliding pairs are verified on the whole fingerprints. That is 3 x (1 + 42
or 43) = 131 variants a fingerprint, against 2,081 for whole fingerprints within two bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demarca.llm.common import by_slice, components, partitions, stored

#: Fingerprints link at this many differing bits or fewer; the erasures below are made for it.
RADIUS = 3

#: Positions of the 64 bits, in the thirds that are erased in turn.
THIRDS = [range(0, 22), range(22, 43), range(43, 64)]

#: Members of a bucket below which pairs are compared at once; a larger one is split by the erased bits first.
SMALL_BUCKET = 64


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """SimHash of a text's shingles, repeats included; bit set if set in over half of them."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(size)
    if len(parts) > words:
        spans = zip((ends - size)[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.array(hashes[at : at + 4096], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(
    docs: DataFrame, words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, fingerprint long) of every whole text; null and wordless texts have zero."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        return lambda ids, texts: [pa.array([signed(fingerprint(t, words, seed)) for t in texts], pa.int64())]

    run = by_slice(["doc_id", "text"], make, ["doc_id", "fingerprint"])
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def variants(prints: DataFrame) -> DataFrame:
    """Rows (third, variant, fingerprint): each fingerprint with one third erased and at most one other bit flipped."""
    made = []
    for third, erased in enumerate(THIRDS):
        keep = (1 << 64) - 1 - sum(1 << b for b in erased)
        flips = [0, *(1 << b for b in range(64) if b not in erased)]
        masks = F.explode(F.array(*[F.lit(signed(x)).cast("long") for x in flips])).alias("flip")
        rows = prints.select("fingerprint", masks)
        variant = F.col("fingerprint").bitwiseAND(F.lit(signed(keep))).bitwiseXOR(F.col("flip"))
        made.append(rows.select(F.lit(third).cast("byte").alias("third"), variant.alias("variant"), "fingerprint"))
    return made[0].unionAll(made[1]).unionAll(made[2])


def bucket_links(members: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all members of a bucket that are within the radius; no all-pairs output.

    Members agree with the variant in all but one kept bit, so those with equal erased
    bits are within two bits: one of them links them all. What is left are members whose
    erased bits differ: pairs of a small bucket are compared; in a large one, erased
    values that differ in one bit meet by flipping it, and members that equal the variant
    itself (erased bits alone differ) meet in the middle again.
    """
    none = np.empty(0, dtype=np.uint64)
    if len(members) <= SMALL_BUCKET:
        a, b = np.triu_indices(len(members), 1)
        near = np.bitwise_count(members[a] ^ members[b]) <= RADIUS
        return members[a[near]], members[b[near]]
    erased = np.uint64(sum(1 << b for b in THIRDS[third]))
    part = members & erased
    order = np.lexsort((members, part))
    members, part = members[order], part[order]
    first = np.r_[True, part[1:] != part[:-1]]
    head = members[first][np.cumsum(first) - 1]
    a, b = [head[~first]], [members[~first]]
    values, heads = part[first], members[first]
    for bit in THIRDS[third]:
        flipped = values ^ np.uint64(1 << bit)
        at = np.searchsorted(values, flipped).clip(max=len(values) - 1)
        met = (values[at] == flipped) & (values < flipped)
        a.append(heads[met])
        b.append(heads[at[met]])
    kept, count = np.unique(members & ~erased, return_counts=True)
    for value in kept[count > 1]:
        own = members[(members & ~erased) == value]
        x, y = close_values(own, THIRDS[third])
        a.append(x)
        b.append(y)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def close_values(members: np.ndarray, bits: range) -> tuple[np.ndarray, np.ndarray]:
    """Connect members, equal outside ``bits``, within three bits: balls of one bit meet balls of two.

    All that share a point at one bit or less are within two of each other, and within
    three of those that reach it with two flips: one of the nearer links them all.
    """
    members = np.unique(members)
    one = [np.uint64(0), *(np.uint64(1 << b) for b in bits)]
    two = [np.uint64((1 << x) | (1 << y)) for x in bits for y in bits if x < y]
    points = np.unique(np.concatenate([members ^ m for m in one]))
    head = np.full(len(points), np.uint64(0xFFFFFFFFFFFFFFFF))
    for m in one:
        np.minimum.at(head, np.searchsorted(points, members ^ m), members)
    a, b = [], []
    for m in [*one, *two]:
        at = np.searchsorted(points, members ^ m).clip(max=len(points) - 1)
        met = (points[at] == (members ^ m)) & (head[at] != members)
        a.append(head[at[met]])
        b.append(members[met])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows sorted by (third, variant); holds a batch and one unfinished bucket."""
    carry = None
    for batch in batches:
        third = batch.column("third").to_numpy()
        variant = batch.column("variant").to_numpy()
        prints = batch.column("fingerprint").to_numpy().view(np.uint64)
        if carry is not None:
            third, variant, prints = (np.concatenate(x) for x in zip(carry, (third, variant, prints), strict=True))
        if not len(third):
            continue
        starts = np.flatnonzero(np.r_[True, (variant[1:] != variant[:-1]) | (third[1:] != third[:-1])])
        carry = third[starts[-1] :], variant[starts[-1] :], prints[starts[-1] :]
        yield from linked(third, prints, starts)
    if carry is not None and len(carry[0]) > 1:
        yield from linked(carry[0], carry[2], np.array([0, len(carry[0])]))


def linked(third: np.ndarray, prints: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of the buckets between ``starts``, as one batch."""
    size = np.diff(starts)
    a, b = [], []
    pair = starts[:-1][size == 2]
    near = np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= RADIUS
    a.append(prints[pair[near]])
    b.append(prints[pair[near] + 1])
    for at, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        x, y = bucket_links(np.unique(prints[at : at + n]), int(third[at]))
        a.append(x)
        b.append(y)
    columns = [np.concatenate(x).view(np.int64) for x in (a, b)]
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Distinct links (a, b) that connect all fingerprints within the radius of each other.

    ``prints`` holds distinct fingerprints, so copies never meet in a bucket. Rows are
    sorted by Spark, which spills, and read as a stream.
    """
    n = partitions(prints.sparkSession)
    rows = variants(prints).repartition(n, "third", "variant").sortWithinPartitions("third", "variant")
    found = rows.mapInArrow(meet, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint long, component_id): one per input row.

    ``component_id`` is the smallest doc_id reachable over links of fingerprints that
    differ in three bits or fewer. Texts with equal fingerprints, wordless ones (zero)
    among them, are one node, so a group of copies of any size is one row of the link
    search. A text of fewer words than a shingle is one shingle. Null ids take part and
    never are the smallest; a component of null ids alone has a null component. No rows
    give no rows; extra columns are not read.
    """
    prints = stored(fingerprints(docs, words, seed, doc_id, text))
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes.select("fingerprint")))
    named = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_per_class(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class: the smallest id, then the smallest text hash.

    Rows that repeat the id and the text are one document, of which the least row stays;
    null ids come first. All wordless texts are one class.
    """
    return one_per(docs, lambda names: classes(names, words, seed, doc_id="name"))


def one_per(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``one_per_class`` for the classes (doc_id, component_id) that ``find`` makes of rows (name, text)."""
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")
    names = docs.select(F.struct("doc_id", text_key).alias("name"), "text")
    first = find(names).where(F.col("doc_id") == F.col("component_id"))
    key = ["id_key", "text_key"]
    first = first.select(F.xxhash64("doc_id.doc_id").alias("id_key"), F.col("doc_id.text_key").alias("text_key")).distinct()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(F.xxhash64("doc_id").alias("id_key"), text_key, own).join(first, key)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("own"))
    return rows.withColumn("place", place).where("place = 1").select("own.*")
