"""Token counts of byte-level BPE with a whole-token shortcut.

Vocabulary strings that the tokenizer encodes alone as one token are proved once, before
any text is read. A pre-token among them counts 1; only the rest are merged, each distinct
one once per task, those of many texts in one call.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demarca.llm.common import by_slice

#: White space of the Latin blocks, by the Unicode property.
BLANK = r"\t-\r\x20\x85\xa0"

#: Outside these blocks character classes may differ between Unicode versions: the library cuts such a text into pre-tokens.
SURE = "\x00-ɏ‐-‧€"
UNSURE = rf"[^{SURE}]"


def of_category(initial: str) -> str:
    """The characters of a Unicode category in the sure blocks, for a character class."""
    sure = re.compile(f"[{SURE}]")
    return "".join(c for c in map(chr, range(1 << 16)) if sure.match(c) and unicodedata.category(c)[0] == initial)


LETTER, NUMBER = of_category("L"), of_category("N")

#: The pre-token pattern of the byte-level vocabularies (a fixed value), its classes written out.
PRE_TOKEN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+"
    rf"| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)

#: Distinct pre-tokens that a task keeps; a full table is emptied, with the same results.
TABLE_TOKENS = 500_000

#: Characters of texts whose pre-tokens are held and merged together, about.
HELD = 1 << 21


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that encode alone as their own single id, at most the vocabulary's size."""
    tokenizer = Tokenizer.from_file(path)
    special = {t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    size = tokenizer.get_vocab_size(with_added_tokens=False)
    texts = tokenizer.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
    texts = [t for t in texts if t and t not in special and "�" not in t]
    coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, coded, strict=True) if len(e) == 1]


def counter(tokenizer: Tokenizer, known: frozenset[str]) -> Callable[[list, list[str | None]], list[pa.Array]]:
    """A function of (ids, texts) that gives bytes, tokens and pre-tokens among ``known`` of every text."""
    specials, merged = [t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]], {}
    pattern, unsure = re.compile(PRE_TOKEN), re.compile(UNSURE)
    cut = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")

    def pre_tokens(text: str) -> list[str]:
        if unsure.search(text):
            return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return pattern.findall(text)

    def parted(text: str) -> tuple[int, int, list[str]]:
        """Special strings, pre-tokens that count 1, and the others."""
        parts = cut.split(text)
        found = [t for p in parts if p for t in pre_tokens(p)]
        rest = [t for t in found if t not in known]
        return len(parts) - 1, len(found) - len(rest), rest

    def settled(made: list[tuple[int, int, list[str]]]) -> list[int]:
        distinct = set().union(*(rest for _, _, rest in made))
        missing = list(distinct.difference(merged))
        if len(merged) + len(missing) > TABLE_TOKENS:
            merged.clear()
            missing = list(distinct)
        if missing:
            for t, e in zip(missing, tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                merged[t] = len(e)
        return [special + ones + sum(map(merged.__getitem__, rest)) for special, ones, rest in made]

    def work(ids: list, texts: list[str | None]) -> list[pa.Array]:
        size, counts, whole, made, held = [], [], [], [], 0
        for text in texts:
            text = text or ""
            size.append(len(text.encode()))
            made.append(parted(text))
            whole.append(made[-1][1])
            held += len(text)
            if held > HELD:
                counts += settled(made)
                made, held = [], 0
        counts += settled(made)
        return [pa.array(c, pa.int64()) for c in (size, counts, whole)]

    return work


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, n_whole) of every whole text.

    ``n_tokens`` is the tokenizer's count without begin, end or added special tokens;
    special strings inside a text count as the special token they are. ``n_whole`` counts
    pre-tokens that the shortcut settled, in texts of any script. A null or empty text has
    zeros. One row per input row, repeats and null ids included; no rows
    give no rows; other columns are not read. No shuffle.
    """
    whole = frozenset(whole_tokens(path))
    shared = docs.sparkSession.sparkContext.broadcast(whole)  # at most the vocabulary's size

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads cost more than they save
        return counter(Tokenizer.from_file(path), shared.value)

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_tokens", "n_whole"]
    return rows.mapInArrow(
        by_slice(["doc_id", "text"], make, names), f"doc_id {kind}, n_bytes long, n_tokens long, n_whole long"
    )
