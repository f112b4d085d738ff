"""Files that hold one JSON array of objects, read by many tasks.

Spark's own reader gives such a file to one task. Here it is cut at closing braces, which
the text source does by byte ranges on any file system. Whether a brace ends an object
depends on all text before it, so there are two passes. The first finds, for each split
and for both cases of its start (inside a string or not), how it ends and how it moves the
nesting depth. Those effects are composed along each file, and then every split knows
where it starts and cuts its objects out exactly; an object over several splits is put
together from its pieces.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: An escaped character in a string.
ESCAPED = re.compile(rb"\\.", re.DOTALL)

#: White space of JSON, the separator, and a byte order mark.
BETWEEN = b" \t\r\n,"
MARK = b"\xef\xbb\xbf"

#: A split is told by its file and first byte; a start is (inside a string, depth, first byte of the split in which the open object starts).
Split = tuple[str, int]
Start = tuple[bool, int, int]


def effect(piece: bytes, inside: bool) -> tuple[bool, int, int]:
    """After a piece of text and the brace that ended it: inside a string, change of depth, change before the brace."""
    parts = (ESCAPED.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    plain = b"".join(parts[inside::2])
    depth = plain.count(b"{") + plain.count(b"[") - plain.count(b"]")
    ends_inside = inside ^ (len(parts) % 2 == 0)
    return ends_inside, depth - (not ends_inside), depth


def pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (file, first, piece) in the order of the text; every piece but a file's last ended in a closing brace."""
    text = spark.read.option("lineSep", "}").text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("first"),
        F.col("value").cast("binary").alias("piece"),
    )


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, Iterator[bytes]]]:
    """The splits of a task with their pieces, one after the other."""

    def flat() -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield from zip(*(part.column(c).to_pylist() for c in ("file", "first", "piece")), strict=True)

    for split, rows in groupby(flat(), key=lambda r: r[:2]):
        yield split, (r[2] for r in rows)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and case of its start: how it ends, its change of depth, and the least depth after a brace."""
    out = defaultdict(list)
    for (file, first), own in by_split(batches):
        now, depth, least = [False, True], [0, 0], [0, 0]
        for piece in own:
            for case in (0, 1):
                now[case], change, _ = effect(piece, now[case])
                depth[case] += change
                least[case] = min(least[case], depth[case])
        for case in (0, 1):
            values = (file, first, bool(case), now[case], depth[case], least[case])
            for name, x in zip(EFFECT.names, values, strict=True):
                out[name].append(x)
    yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in EFFECT}, schema=EFFECT)


EFFECT = pa.schema(
    [("file", pa.string()), ("first", pa.int64()), ("inside", pa.bool_()), ("ends", pa.bool_()), ("change", pa.int64()), ("least", pa.int64())]
)


def starts(effects: list[tuple]) -> dict[Split, Start]:
    """Where each split starts, from the effects of all splits; raises if a file's text doesn't come out even."""
    cases: dict[Split, dict[bool, tuple[bool, int, int]]] = defaultdict(dict)
    for file, first, inside, ends, change, least in effects:
        cases[file, first][inside] = (ends, change, least)
    found: dict[Split, Start] = {}
    for file, own in groupby(sorted(cases), key=lambda s: s[0]):
        inside, depth, owner = False, 0, -1
        for split in own:
            found[split] = (inside, depth, owner)
            ends, change, least = cases[split][inside]
            if depth <= 1 or depth + least <= 1:  # an object that is open at the end started here
                owner = split[1]
            inside, depth = ends, depth + change
        if inside or depth != -1:  # the end of the text counts as one more brace
            raise ValueError(f"not a whole JSON array: {file}")
    return found


def cut(at: dict[Split, Start]):
    """Rows (file, owner, part, value) of a task's splits: whole objects with no owner, pieces of others with one."""

    def objects(split: Split, own: Iterator[bytes]) -> Iterator[tuple[int | None, bytes]]:
        inside, depth, owner = at[split]
        open_ = [] if depth > 1 else None
        for piece in own:
            if open_ is None:
                if not depth:
                    text = piece.removeprefix(MARK).lstrip(BETWEEN[:4])
                    if not text.startswith(b"["):
                        raise ValueError(f"not a JSON array: {split[0]}")
                    piece, depth = text[1:], 1
                begin = piece.find(b"{")
                if begin < 0:
                    if piece.strip(BETWEEN[:4] + b",") != b"]":
                        raise ValueError(f"something else than objects in the array: {split[0]}, after byte {split[1]}")
                    return
                if piece[:begin].strip(BETWEEN):
                    raise ValueError(f"something else than objects in the array: {split[0]}, after byte {split[1]}")
                piece, open_, owner = piece[begin:], [], split[1]
            inside, change, _ = effect(piece, inside)
            depth += change
            open_ += [piece, b"}"]
            if depth == 1 and not inside:
                whole = b"".join(open_)
                yield (None if owner == split[1] else owner), whole
                open_ = None
        if open_:
            yield owner, b"".join(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split, own in by_split(batches):
            rows: list[tuple[int | None, bytes]] = []
            for row in objects(split, own):
                rows.append(row)
                if len(rows) == 1024:
                    yield batch(split, rows)
                    rows = []
            yield batch(split, rows)

    def batch(split: Split, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        arrays = [
            pa.array([split[0]] * n, pa.string()),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([split[1]] * n, pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "owner", "part", "value"])

    return run


def array_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (file, value): the text of every object in the arrays of some files, in no set order.

    A file holds one array of objects, in UTF-8, with white space anywhere; an empty file
    gives no rows. Text before or after the array, elements that are no objects, and an
    array without its end raise; commas aren't checked, nor a single brace as the last character.

    The first pass runs when this is called. It gathers two short rows per split of
    ``spark.sql.files.maxPartitionBytes``, about a millionth of the text.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = pieces(spark, paths)
    effects = text.mapInArrow(measure, "file string, first long, inside boolean, ends boolean, change long, least long")
    at = starts([tuple(r) for r in effects.collect()])
    found = text.mapInArrow(cut(at), "file string, owner long, part long, value binary")
    value = F.col("value").cast("string").alias("value")
    parts = found.where(F.col("owner").isNotNull()).groupBy("file", "owner")
    joined = F.array_sort(F.collect_list(F.struct("part", value)))
    text_of = F.array_join(F.transform(joined, lambda p: p["value"]), "")
    whole = found.where(F.col("owner").isNull()).select("file", value)
    return whole.unionByName(parts.agg(text_of.alias("value")).select("file", "value"))


def read_json_arrays(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """The objects as rows of a schema, as ``from_json`` makes them.

    In a text column a number is written in its shortest form and a nested value without
    blanks; strings are what they are.
    """
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return array_objects(spark, paths).select(parsed.alias("row")).select("row.*")
