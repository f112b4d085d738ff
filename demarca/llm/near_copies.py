"""Near copies by SimHash ball hashing, linked by exact shingle similarity.

A text has a fingerprint of four parts of 32 bits, SimHashes of its distinct words; each part
reads another quarter of the vocabulary, so that edits rarely spoil all of them. A part's
radius is two bits: every part emits its 33 variants within one bit, half the radius, variants
are shuffled, and texts that share one are candidates. Texts that differ in eleven of the 128
bits or fewer always share a variant, others by chance. Candidates link if the Jaccard similarity of
their sets of five-word shingles, taken from the whole texts, is 0.8 or more: no link is wrong.

In a large bucket texts first meet at hubs, which joins most of a group of near copies with few
comparisons. Members that are in different classes after that are held against each other by
sketches of their shingles, which never tell a similar pair apart; only pairs that pass become
rows, at first no more than connect them. So the classes are those that all pairs of candidates
give, and the rows are about as many as the links that were missing.

On the tables it was tried on, 0.99 of the linked pairs or more are found in every band from
0.8 on. A passage replaced or appended as a block moves a text's fingerprint further (README).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import by_slice, components, partitions, stored

#: Words of a shingle; a shorter text is one shingle, so it links to none but its copies.
WORDS = 5

#: Sets link at this similarity or more, in fifths.
FIFTHS = 4

#: Parts of a fingerprint, and their bits.
PARTS, BITS = 4, 32

#: A part reads all words of a text that has fewer of its quarter of the vocabulary.
FEWEST = 8

#: Candidates differ in this many of the 128 bits or fewer; unrelated texts do in 43 or more (99.9 %).
FAR = 36

#: Members of a bucket up to which all pairs are candidates; those of a larger one meet at hubs first.
SMALL_BUCKET = 16

#: A member this near to a hub becomes no hub.
NEAR = 8

#: Members of a large bucket that are held at a time, beside its hubs; also those of a block.
PIECE = 4096

#: Members that are compared with one reading of a hub's shingles, on average.
SHEAF = 256

#: Members that are compared with a block at a time.
STRIP = 256

#: Bits of a sketch for each shingle, at least; and bytes of sketches that are compared at a time.
SKETCH, CHUNK = 4, 1 << 22

#: Members of a bucket are rows (first, second, node) of unsigned numbers.
NONE = np.empty((0, 3), dtype=np.uint64)


def parted(text: str | None) -> list[bytes]:
    """A text's words; A-Z in lower case."""
    return (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count


def node_of(parts: list[bytes]) -> int:
    """The 64-bit hash of a sequence of words, as Spark's long."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(parts))).view(np.int64))


def shingles(parts: list[bytes]) -> np.ndarray:
    """The shingles of a sequence of words, as sorted distinct hashes; none without words."""
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(size)
    spans = zip((ends - size)[: len(parts) - WORDS + 1].tolist(), (ends[WORDS - 1 :] - 1).tolist(), strict=True)
    if len(parts) >= WORDS:
        hashes = [xxhash.xxh64_intdigest(joined[a:b]) for a, b in spans]
    else:
        hashes = [xxhash.xxh64_intdigest(joined)] if parts else []
    return np.unique(np.array(hashes, dtype=np.uint64)).view(np.int64)


def fingerprint(parts: list[bytes]) -> tuple[int, int]:
    """Four SimHashes of 32 bits, as two longs; a bit is set if set in over half of a part's words."""
    own = list(set(parts))
    sums = np.zeros((PARTS + 1, PARTS, BITS), dtype=np.int64)  # by quarter of the vocabulary; the last row is for all
    many = np.zeros(PARTS + 1, dtype=np.int64)
    for at in range(0, len(own), 4096):
        block = own[at : at + 4096]
        bits = np.frombuffer(b"".join(map(xxhash.xxh128_digest, block)), dtype=np.uint8).reshape(-1, PARTS, BITS // 8)
        bits = np.unpackbits(bits, axis=2)
        quarter = np.fromiter(map(zlib.crc32, block), dtype=np.int64, count=len(block)) % PARTS
        for part in range(PARTS):
            mine = quarter == part
            many[part] += mine.sum()
            sums[part, part] += bits[mine, part].sum(axis=0, dtype=np.int64)
        sums[PARTS] += bits.sum(axis=0, dtype=np.int64)
    many[PARTS] = len(own)
    use = [part if many[part] >= FEWEST else PARTS for part in range(PARTS)]
    set_bits = np.stack([2 * sums[u, part] > many[u] for part, u in enumerate(use)])
    first, second = np.packbits(set_bits.reshape(2, -1), axis=1).view(">i8").ravel().tolist()
    return first, second


def variants(prints: DataFrame) -> DataFrame:
    """Rows (spot, first, second, node): ``spot`` is a part's number and value with at most one bit flipped."""
    low = F.lit((1 << BITS) - 1)
    values: list[Column] = []
    for half in ("first", "second"):
        values += [F.shiftrightunsigned(half, BITS), F.col(half).bitwiseAND(low)]
    flips = F.explode(F.array(*[F.lit(x).cast("long") for x in (0, *(1 << b for b in range(BITS)))])).alias("flip")
    rows = prints.select("first", "second", "node", flips)
    spots = [v.bitwiseXOR(F.col("flip")).bitwiseOR(F.lit(part << BITS).cast("long")) for part, v in enumerate(values)]
    return rows.select(F.explode(F.array(*spots)).alias("spot"), "first", "second", "node")


def apart(members: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints (the first two numbers of rows) differ from another."""
    return np.bitwise_count(members[..., :2] ^ one[..., :2]).sum(axis=-1, dtype=np.int64)


def least_spot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least spot that members share, row by row; -1 where no part is within its radius."""
    spot = np.full(len(a), -1, dtype=np.int64)
    for part in reversed(range(PARTS)):
        half, down = part // 2, np.uint64(BITS * (1 - part % 2))
        x, y = ((m[:, half] >> down) & np.uint64((1 << BITS) - 1) for m in (a, b))
        differ = x ^ y
        low = differ & (~differ + np.uint64(1))
        highest = np.uint64(1) << np.maximum(np.frexp(x.astype(float))[1] - 1, 0).astype(np.uint64)
        least = np.where(differ == 0, x & ~highest, np.minimum(x ^ low, x ^ differ ^ low))
        spot = np.where(np.bitwise_count(differ) <= 2, least.astype(np.int64) | (part << BITS), spot)
    return spot


def at_hubs(members: np.ndarray, hubs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (a, b) of a part of a large bucket, as members, and the hubs with new ones.

    Members become hubs from the middle of the bucket outwards, unless one is near already.
    Each member, hubs too, is a candidate with every hub that is nearer to it than all
    before, until one is near: a few rows, and at most one for each distance. Near copies
    that no hub links are left to ``crossing``.
    """
    bits = np.unpackbits(np.ascontiguousarray(members[:, :2]).view(np.uint8), axis=1)
    middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(members)).view(np.uint64)
    best, unsettled = np.full(len(members), FAR + 1), np.ones(len(members), dtype=bool)
    made, a, b = list(hubs), [members[:0]], [members[:0]]

    def meets(hub: np.ndarray) -> None:
        rest = np.flatnonzero(unsettled)
        d = apart(members[rest], hub)
        better = d < best[rest]
        best[rest[better]] = d[better]
        a.append(np.broadcast_to(hub, (int(better.sum()), len(hub))))
        b.append(members[rest[better]])
        unsettled[rest[d <= NEAR]] = False

    for hub in hubs:
        meets(hub)
    for i in np.argsort(apart(members, middle), kind="stable").tolist():
        if unsettled[i]:
            unsettled[i] = False
            made.append(members[i])
            meets(members[i])
    return np.concatenate(a), np.concatenate(b), np.array(made, dtype=np.uint64).reshape(-1, members.shape[1])


def nodes_of(members: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([NONE, *members])[:, 2].astype(np.int64)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (spot, a, b) from rows sorted by spot: candidates (null spot), and the members (null b) of large buckets.

    Holds a batch, a piece of a bucket and the hubs of a large one.
    """
    spot, members, hubs = np.empty(0, dtype=np.int64), NONE, NONE
    open_spot = None  # of a large bucket whose former pieces are done

    def rows(a: list[np.ndarray], b: list[np.ndarray], spots: list[int], large: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, y, own = nodes_of(a), nodes_of(b), nodes_of(large)
        at = np.repeat(np.array(spots, dtype=np.int64), [len(m) for m in large])
        if len(x) + len(own):
            columns = [
                pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(at)]),
                pa.array(np.concatenate([x, own])),
                pa.concat_arrays([pa.array(y), pa.nulls(len(own), pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["spot", "a", "b"])

    def done(starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, a, b, spots, large = np.diff(starts), [], [], [], []
        for at, n in zip(starts[:-1].tolist(), size.tolist(), strict=True):
            own = members[at : at + n]
            if spot[at] == open_spot or n > SMALL_BUCKET:
                x, y, _ = at_hubs(own, hubs if spot[at] == open_spot else NONE)
                spots.append(int(spot[at]))
                large.append(own)
            elif n > 1:
                i, j = np.triu_indices(n, 1)
                close = apart(own[i], own[j]) <= FAR
                x, y = own[i[close]], own[j[close]]
            else:
                continue
            a.append(x)
            b.append(y)
        yield from rows(a, b, spots, large)

    for batch in batches:
        new = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("first", "second", "node")], axis=1)
        spot, members = np.concatenate([spot, batch.column("spot").to_numpy()]), np.concatenate([members, new])
        if not len(spot):
            continue
        starts = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
        yield from done(starts)
        spot, members = spot[starts[-1] :], members[starts[-1] :]
        if len(spot) >= PIECE:
            a, b, hubs = at_hubs(members, hubs if spot[0] == open_spot else NONE)
            open_spot = int(spot[0])
            yield from rows([a], [b], [open_spot], [members])
            spot, members = spot[:0], NONE
    if len(spot):
        yield from done(np.array([0, len(spot)]))


def meetings(prints: DataFrame) -> DataFrame:
    """The rows of ``meet`` for rows (first, second, node)."""
    n = partitions(prints.sparkSession)
    spots = variants(prints).repartition(n, "spot").sortWithinPartitions("spot", "first", "second")
    return spots.mapInArrow(meet, "spot long, a long, b long")


def in_pairs(met: DataFrame) -> DataFrame:
    """The distinct candidates (a, b) among the rows of ``meet``."""
    return met.where("spot IS NULL").select("a", "b").distinct()


def candidates(prints: DataFrame) -> DataFrame:
    """Distinct candidates (a, b) of nodes from rows (first, second, node), those of large buckets through hubs."""
    return in_pairs(meetings(prints))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For a power of two of bins, whether an odd number of shingles falls into each, as 64-bit words.

    Each shingle that one of two sets has alone changes one bin, so sketches differ in no more
    bins than the sets in shingles. Half as many bins are the halves' exclusive or.
    """
    bins = max(64, 1 << (SKETCH * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens.view(np.uint64) & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches as rows of ``words`` words; those of twice as many are folded, others are left zero."""
    out = np.zeros((len(sketches), words), dtype=np.uint64)
    for row, own in zip(out, sketches, strict=True):
        if len(own) in (words, 2 * words):
            row[:] = own if len(own) == words else own[:words] ^ own[words:]
    return out


def may_link(i: np.ndarray, j: np.ndarray, size: tuple, sketches: tuple, known: dict[int, np.ndarray]) -> np.ndarray:
    """For pairs (i of the first, j of the second set list), whether sizes and sketches allow the threshold.

    Of A and B shingles no more than (A + B) / 9 may be in one set alone. ``known`` keeps
    the second list's folded sketches between calls.
    """
    a, b = size[0][i], size[1][j]
    fits = 9 * np.abs(a - b) <= a + b
    words = [np.fromiter(map(len, s), dtype=np.int64, count=len(s)) for s in sketches]
    least = np.where(fits, np.minimum(words[0][i], words[1][j]), 0)
    for n in np.unique(least[fits]).tolist():
        if n not in known:
            known[n] = folded(sketches[1], n)
        first, at = folded(sketches[0], n), np.flatnonzero(least == n)
        step = max(1, CHUNK // (8 * n))
        for some in (at[k : k + step] for k in range(0, len(at), step)):
            differ = np.bitwise_count(first[i[some]] ^ known[n][j[some]]).sum(axis=1, dtype=np.int64)
            fits[some] = 9 * differ <= a[some] + b[some]
    return fits


def crossed(spanning: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (spot, a, b) of different roots from rows (spot, block, moves, minor, first, second, node, root, size, sketch).

    A block's own rows come first. Holds a batch and a block. A pair comes out only if its
    sketches allow a link, only at the least spot that its members share, and once where both
    are minor. With ``spanning`` a block's pairs that the ones before would connect stay out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block_of = None, [], None
        for batch in batches:
            spot, block = (batch.column(c).to_numpy() for c in ("spot", "block"))
            moves, minor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("moves", "minor"))
            rows = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("first", "second", "node", "root")], axis=1)
            size = batch.column("size").to_numpy()
            drawn = [np.frombuffer(x, dtype="<u8") for x in batch.column("sketch").to_pylist()]
            edges = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (block[1:] != block[:-1]) | (moves[1:] != moves[:-1])])
            met, a, b = [edges[:0]], [], []
            for at, end in zip(edges.tolist(), [*edges[1:].tolist(), len(spot)], strict=True) if len(spot) else ():
                if (spot[at], block[at]) != now:
                    now, held, block_of = (spot[at], block[at]), [], None
                if not moves[at]:
                    held.append((rows[at:end], minor[at:end], size[at:end], drawn[at:end]))
                    continue
                if block_of is None:
                    *parts, last = zip(*held, strict=True)
                    block_of = [*map(np.concatenate, parts), [x for part in last for x in part], {}, Roots(np.concatenate(parts[0])[:, 3])]
                own, twice, own_size, own_drawn, known, roots = block_of
                for s in range(at, end, STRIP):
                    e = min(s + STRIP, end)
                    part = rows[s:e]
                    near = (apart(part[:, None], own) <= FAR) & (part[:, 3, None] != own[:, 3])
                    near &= ~twice | (part[:, 2, None] < own[:, 2])
                    i, j = np.nonzero(near)
                    here = least_spot(part[i], own[j]) == spot[at]
                    i, j = i[here], j[here]
                    here = may_link(i, j, (size[s:e], own_size), (drawn[s:e], own_drawn), known)
                    i, j = i[here], j[here]
                    if spanning:
                        i, j = roots.spanning(part[:, 3], i, j)
                    met.append(np.full(len(i), spot[at]))
                    a.append(part[i, :3])
                    b.append(own[j, :3])
            columns = [np.concatenate(met), nodes_of(a), nodes_of(b)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["spot", "a", "b"])

    return run


class Roots:
    """The roots of a block's members, joined by the pairs that were let through."""

    def __init__(self, root: np.ndarray):
        self.now, self.into = root.copy(), {}

    def spanning(self, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs, sorted by ``i``, that join members (``root[i]`` and a block's) not joined before."""
        out = [np.empty(0, dtype=np.int64)]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])[: len(i)]
        for at, end in zip(first, [*first[1:], len(i)][: len(i)], strict=True):
            mine = int(root[i[at]])
            while mine in self.into:
                mine = self.into[mine]
            others, which = np.unique(self.now[j[at:end]], return_index=True)
            new = others != np.uint64(mine)
            if new.any():
                out.append(at + which[new])
                self.now[np.isin(self.now, others[new])] = mine
                self.into.update(dict.fromkeys(others[new].tolist(), mine))
        kept = np.concatenate(out)
        return i[kept], j[kept]


def shapes(known: DataFrame) -> DataFrame:
    """Rows (node, size, sketch) from rows (node, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, dtype="<i8") for x in batch.column("tokens").to_pylist()]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=["node", "size", "sketch"])

    return known.select("node", "tokens").mapInArrow(run, "node long, size long, sketch binary")


def crossing(large: DataFrame, members: DataFrame, drawn: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (spot, a, b) of candidates that share a large bucket, have different roots and may link by their sketches.

    From rows (spot, node) of large buckets, (node, first, second, root) and ``shapes``. In a
    bucket the members outside its most frequent root, the minor ones, go to all its blocks,
    and each block compares them with its own members: a bucket of any size is many tasks'
    work, and one that has a single root is none.
    """
    n = partitions(large.sparkSession)
    spots = large.groupBy("node").agg(F.collect_list("spot").alias("spots"))  # a text has 132 at most
    laid = spots.join(members, "node").join(drawn, "node").withColumn("spot", F.explode("spots")).drop("spots")
    laid = stored(laid)
    sizes = laid.groupBy("spot", "root").count().groupBy("spot")
    mixed = sizes.agg(
        F.ceil(F.sum("count") / PIECE).cast("int").alias("blocks"), F.max_by("root", "count").alias("main"), F.count("*").alias("roots")
    )
    laid = laid.join(mixed.where("roots > 1"), "spot").withColumn("minor", F.expr("root != main"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    row = ["minor", "first", "second", "node", "root", "size", "sketch"]
    rows = laid.select("spot", own, F.lit(False).alias("moves"), *row)
    rows = rows.unionAll(laid.where("minor").select("spot", every, F.lit(True).alias("moves"), *row))
    rows = rows.repartition(n, "spot", "block").sortWithinPartitions("spot", "block", "moves", "node")
    return rows.mapInArrow(crossed(spanning), "spot long, a long, b long")


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (sheaf, hub, other, tokens) sorted by sheaf, hub rows (null other) first; holds one hub."""
    now, own = None, None
    for batch in batches:
        a, b = [], []
        for sheaf, hub, other, tokens in zip(*(batch.column(c) for c in ("sheaf", "hub", "other", "tokens")), strict=True):
            if not other.is_valid:
                now, own = (sheaf.as_py(), hub.as_py()), np.frombuffer(tokens.as_py(), dtype="<i8")
                continue
            if (sheaf.as_py(), hub.as_py()) != now:
                raise ValueError("rows of a sheaf without its hub")
            its = np.frombuffer(tokens.as_py(), dtype="<i8")
            if FIFTHS * max(len(own), len(its)) > 5 * min(len(own), len(its)):
                continue
            both = len(np.intersect1d(own, its, assume_unique=True))
            if 5 * both >= FIFTHS * (len(own) + len(its) - both):
                a.append(now[1])
                b.append(other.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ``tokens``, from rows (node, tokens), reach the threshold.

    A node's partners are dealt into sheaves by hash, so a hub of any number of texts is many
    tasks' work; each reads the hub's shingles once and the partners' as a stream.
    """
    n = partitions(pairs.sparkSession)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHEAF).alias("sheaves"))
    dealt = pairs.join(many, "a").select(F.pmod(F.xxhash64("b"), F.col("sheaves")).alias("sheaf"), "a", "b")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sheaves") - 1)).alias("sheaf")
    hubs = many.select(every, "a", F.lit(None).cast("long").alias("b"))
    rows = dealt.unionAll(hubs).withColumn("node", F.coalesce("b", "a")).join(known, "node")
    laid = rows.select("sheaf", F.col("a").alias("hub"), F.col("b").alias("other"), "tokens")
    laid = laid.repartition(n, "sheaf", "hub").sortWithinPartitions("sheaf", "hub", F.asc_nulls_first("other"))
    return laid.mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, component_id): one per input row.

    ``component_id`` is the smallest doc_id reachable over links of candidates whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more. Texts equal but for A-Z
    case and white space, wordless ones among them, are one node. Null ids take part and
    never are the smallest. No rows give no rows; extra columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def names(ids, texts):
        made = [parted(t) for t in texts]
        prints = [fingerprint(p) if len(p) >= WORDS else (None, None) for p in made]
        return [pa.array(c, pa.int64()) for c in ([node_of(p) for p in made], *map(list, zip(*prints, strict=True)))]

    def sets(texts):
        made = [parted(t) for t in texts]
        return [pa.array([node_of(p) for p in made], pa.int64()), pa.array([shingles(p).tobytes() for p in made], pa.binary())]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (b.select(["node", "tokens"]) for b in by_slice(["text"], lambda: sets, ["text", "node", "tokens"])(batches))

    named = by_slice(["doc_id", "text"], lambda: names, ["doc_id", "node", "first", "second"])
    placed = stored(rows.mapInArrow(named, f"doc_id {kind}, node long, first long, second long"))
    nodes = stored(placed.groupBy("node", "first", "second").agg(F.min("doc_id").alias("least_id")))
    prints = nodes.where("first is not null").select("first", "second", "node")
    met = stored(meetings(prints))
    pairs = stored(in_pairs(met))

    both = met.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    wanted = nodes.join(both, "node").select(F.xxhash64("least_id").alias("id_key")).distinct()
    texts = rows.withColumn("id_key", F.xxhash64("doc_id")).join(wanted, "id_key", "left_semi").select("text")
    known = stored(texts.mapInArrow(whole, "node long, tokens binary").groupBy("node").agg(F.min("tokens").alias("tokens")))
    roots = components(links(pairs, known))

    large = met.where("spot is not null").select("spot", F.col("a").alias("node"))
    drawn = stored(shapes(known.join(large.distinct(), "node", "left_semi")))
    for spanning in (True, False):
        rooted = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = stored(crossing(large, rooted, drawn, spanning))
        if left.isEmpty():
            break
        late = stored(links(left, known))
        failed = left.join(late, ["a", "b"], "left_anti").select("spot").distinct()
        large = large.join(failed, "spot", "left_semi")  # a pair that doesn't link may have kept out one that does
        if not late.isEmpty():
            roots = components(late.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    nodes = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    nodes = nodes.select("node", "root").join(least, "root").select("node", "component_id")
    return placed.select("doc_id", "node").join(nodes, "node").select("doc_id", "component_id")
