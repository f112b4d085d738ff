"""Token ids as fixed-stride records in training order.

Documents are cut into sequences of equal length and numbered. A keyed Feistel network
permutes numbers of an even count of bits; walking its cycle until the number is small
enough makes it a permutation of the sequences, so a slot is computed, not drawn, and can
be traced back. Range partitions of slots hold whole shards in order, and a record's place
in its shard is its slot times the stride.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import SLICE, numbered, partitions, stored
from demarca.llm.pieces import WordTable, crossing_pieces

#: Tokens of a record, two bytes each; a shorter sequence is filled up with zeros.
LENGTH = 512

#: Records of a shard.
SHARD_RECORDS = 16_384

ROUNDS = 6


class Permutation:
    """A keyed permutation of 0 .. size - 1 and its inverse, on arrays."""

    def __init__(self, size: int, key: int):
        self.size, bits = size, max(2, (max(size, 1) - 1).bit_length())
        self.half = np.uint64((bits + 1) // 2)
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        """The round function: any bits of ``x`` spread over a half."""
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def once(self, x: np.ndarray, back: bool) -> np.ndarray:
        """One pass through the network, or back through it."""
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self.mixed(left, key), left
            else:
                left, right = right, left ^ self.mixed(right, key)
        return (left << self.half) | right

    def walk(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """Slots of numbers, or numbers of slots: passes until each value is below ``size``."""
        x = self.once(np.asarray(x, dtype=np.uint64), back)
        while (out := x >= np.uint64(self.size)).any():
            x[out] = self.once(x[out], back)
        return x.astype(np.int64)


def sequences(docs: DataFrame, model: str, length: int, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, seq_no, n_tokens, record) of every whole text, with an end id after each text."""
    if crossing := crossing_pieces(model):
        raise ValueError(f"words can't be segmented alone, pieces cross markers: {crossing[:5]}")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model)
        end = np.asarray([table.sp.eos_id()], dtype=np.int32)
        if table.sp.get_piece_size() > 1 << 16:
            raise ValueError("ids of more than two bytes")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, seq, size, record = [], [], [], []
                for i, coded in enumerate(table.many([t or "" for t in part.column("text").to_pylist()])):
                    ids = np.concatenate([np.frombuffer(coded, dtype=np.int32), end]).astype("<u2")
                    for n, first in enumerate(range(0, len(ids), length)):
                        piece = ids[first : first + length]
                        row.append(i)
                        seq.append(n)
                        size.append(len(piece))
                        record.append(piece.tobytes().ljust(2 * length, b"\0"))
                columns = [
                    part.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(seq, pa.int32()),
                    pa.array(size, pa.int32()),
                    pa.array(record, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "seq_no", "n_tokens", "record"])

    return rows.mapInArrow(run, f"doc_id {kind}, seq_no int, n_tokens int, record binary")


def arranged(
    docs: DataFrame,
    model: str,
    key: int,
    length: int = LENGTH,
    shard_records: int = SHARD_RECORDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows (doc_id, seq_no, n_tokens, record, slot, shard, offset) in shards, sorted by slot.

    ``record`` holds ``length`` little-endian 16-bit ids; ``offset`` is its first byte in
    its shard. Slots run from 0 without gaps over all sequences. A null or empty text is
    one sequence with the end id; repeats and null ids are rows like others; no rows give
    none. The step before the permutation is stored, in the order of the table, so a lost
    executor can't change a number; only one count per partition is gathered. Other
    columns are not read.
    """
    made = sequences(docs, model, length, doc_id, text).withColumn("_at", F.monotonically_increasing_id())
    rows, total = numbered(stored(made, compression="zstd"), "number")
    order = Permutation(total, key)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(order.walk(number.to_numpy()))

    n = partitions(docs.sparkSession)
    placed = rows.withColumn("slot", slot("number")).drop("number")
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {shard_records} as int)"))
    placed = placed.withColumn("offset", (F.col("slot") % shard_records) * (2 * length))
    return placed.repartitionByRange(n, "shard").sortWithinPartitions("slot")


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder (local or shared path, or URI of hdfs, s3 or gs) and the path on it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def shard_name(shard: int) -> str:
    return f"{shard:08d}.bin"


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Write the shards of ``arranged`` to a shared folder, by the task that holds them; returns the rows of ``records``.

    Each row carries its shard's ``path`` and ``shard_crc32``, and comes out when its shard
    is whole under that name. Every attempt of a task writes under a name of its own and
    renames at the end; attempts write the same bytes, so it doesn't matter which one stays.
    Null ids and repeated rows are records like others; no rows write nothing. Nothing is
    written before the rows are asked for.
    """
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        files.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        shard, sink, crc, held = None, None, 0, []

        def whole() -> Iterator[pa.RecordBatch]:
            sink.close()
            own, final = f"{root}/{shard:08d}.{attempt}.part", f"{root}/{shard_name(shard)}"
            if files.get_file_info(final).type == pyarrow.fs.FileType.File:
                files.delete_file(own)
            else:
                files.move(own, final)
            for part in held:
                n = part.num_rows
                told = [pa.array([f"{folder}/{shard_name(shard)}"] * n), pa.array([crc] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *told], names=[*names, "path", "shard_crc32"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else []
            for at, end in zip(cuts, [*cuts[1:], len(shards)], strict=True):
                if shards[at] != shard:
                    if sink:
                        yield from whole()
                    shard, crc, held = int(shards[at]), 0, []
                    sink = files.open_output_stream(f"{root}/{shard:08d}.{attempt}.part")
                part = batch.slice(at, end - at)
                data = b"".join(part.column("record").to_pylist())
                sink.write(data)
                crc = zlib.crc32(data, crc)
                held.append(part)
        if sink:
            yield from whole()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    return records.mapInArrow(run, f"{kinds}, path string, shard_crc32 long")


def read_records(folder: str, first: int, count: int, length: int = LENGTH, shard_records: int = SHARD_RECORDS):
    """Records of ``count`` slots from ``first`` on, as an array; reading goes on anywhere by seeking.

    Slots behind the last one give fewer records; a folder without shards gives none.
    """
    files, root = opened(folder)
    out = []
    while count > 0:
        shard, inside = divmod(first, shard_records)
        path = f"{root}/{shard_name(shard)}"
        if files.get_file_info(path).type != pyarrow.fs.FileType.File:
            break
        with files.open_input_file(path) as source:
            source.seek(inside * 2 * length)
            data = source.read(min(count, shard_records - inside) * 2 * length)
        got = np.frombuffer(data, dtype="<u2").reshape(-1, length)
        if not len(got):
            break
        out.append(got)
        first, count = first + len(got), count - len(got)
    return np.concatenate(out) if out else np.empty((0, length), dtype="<u2")
