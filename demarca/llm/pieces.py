"""SentencePiece encoding and decoding over a table of distinct marked words.

The library writes a space as a marker and puts one before the text. Where no piece has
a marker after another character, no merge crosses from a word into the next marker, so
a text's ids are its marked words' ids in a row. Each task segments a distinct marked
word once, keeps its ids in a table and joins them back by position.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import by_slice

#: The character that stands for a space in pieces.
MARKER = "▁"

#: Distinct words that a task keeps; a full table is emptied and filled anew, with the same results.
TABLE_WORDS = 500_000


def crossing_pieces(model: str) -> list[str]:
    """Pieces with a marker after another character; a model with any can't be cut into words."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return [p for p in pieces if MARKER in p.lstrip(MARKER)]


class WordTable:
    """Ids of marked words, each segmented once; a word comes without the one marker before it."""

    def __init__(self, model: str, limit: int = TABLE_WORDS):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.limit, self.made = limit, {}

    def add(self, missing: list[str]) -> None:
        """Segment words that the table lacks."""
        for word, ids in zip(missing, self.sp.encode(missing, num_threads=1), strict=True):
            self.made[word] = array("i", ids).tobytes()
        if "" in self.made:  # a lone marker; the library gives an empty text none
            self.made[""] = array("i", [self.sp.piece_to_id(MARKER)]).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as 32-bit numbers, without begin and end; words of all texts are added at once."""
        parts = [self.words(t) for t in texts]
        missing = [w for w in set().union(*parts) if w not in self.made]
        if len(self.made) + len(missing) > self.limit:
            self.made.clear()
            missing = list(set().union(*parts))
        if missing:
            self.add(missing)
        return [b"".join(map(self.made.__getitem__, p)) for p in parts]

    def words(self, text: str) -> list[str]:
        """Marked words of a text, each without the one marker before it."""
        if not text:
            return []
        parts = text.replace(MARKER, " ").split(" ")
        return self.joined(parts) if "" in parts else parts

    @staticmethod
    def joined(parts: list[str]) -> list[str]:
        """Give each run of markers to the word that follows it; a run at the end stands alone."""
        out, spaces = [], 0
        for part in parts[:-1]:
            if part:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        out.append(" " * spaces + parts[-1])
        return out


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """Rows (doc_id, ids array<int>, decoded string) of every whole text.

    ``ids`` equals the library's encoding without sampling, with the end id if ``end``;
    ``decoded`` is the library's decoding of those ids. A null or empty text has the end
    id only and decodes to an empty text. One row comes out per row that goes in, repeats
    and null ids included; no rows give no rows; other columns are not read. No shuffle:
    memory is a table of words and a slice of texts per task.
    """
    if crossing := crossing_pieces(model):
        raise ValueError(f"words can't be segmented alone, pieces cross markers: {crossing[:5]}")

    def make():
        table = WordTable(model)
        last = np.asarray([table.sp.eos_id()] if end else [], dtype=np.int32).tobytes()

        def work(ids, texts):
            coded = [c + last for c in table.many([t or "" for t in texts])]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            values = np.frombuffer(b"".join(coded), dtype=np.int32)
            lists = [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            decoded = table.sp.decode(lists, num_threads=1) if lists else []
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(decoded, pa.string())]

        return work

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        by_slice(["doc_id", "text"], make, ["doc_id", "ids", "decoded"]), f"doc_id {kind}, ids array<int>, decoded string"
    )
