"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demarca.llm import (
    common,
    decontamination,
    line_runs,
    mixture,
    pieces,
    quality_rules,
    simhash,
    suffix_spans,
    token_counts,
    toxicity,
    training_order,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"

rng = np.random.default_rng(7)
VOCABULARY = ["".join(rng.choice(list("abcdeéßñ"), rng.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCABULARY, n))


LONG = prose(6000, 1)
PASSAGE = prose(90, 2)
TEXTS = [
    (1, f"{prose(50, 3)}\n{PASSAGE}\n{prose(40, 4)}", "en", "a", 1),
    (2, f"{PASSAGE}\n{prose(60, 5)}", "en", "a", 1),
    (3, f"{prose(60, 6)} {PASSAGE}", "de", None, None),
    (4, None, None, "b", None),
    (5, "", "en", "b", 0),
    (6, "   \t\n ", "en", "b", 0),
    (7, LONG, "fr", "a", 1),
    (8, LONG, "fr", "a", 1),
    (9, LONG.replace(VOCABULARY[3], "changed", 1), None, "c", 1),
    (10, "a", "en", "c", 1),
    (11, "x " * 300, "en", "c", 1),
    (11, "x " * 300, "en", "c", 1),
    (None, prose(30, 8), "en", "c", 1),
    (12, "Ünï  ▁ \u0000 \U0001f600 <|endoftext|> </s> don't 'S    中文 x\r\n y", "es", "c", 1),
    (13, f"{prose(30, 9)}\n\n\n{prose(30, 9)}", "es", "d", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with an extra column under the name of an output."""
    return spark.createDataFrame(TEXTS, KIND).withColumns({"n_tokens": F.lit("clash"), "m": F.lit(1), "own": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# SentencePiece


def test_pieces_equal_the_library(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode(docs, MODEL).collect())
    want = Counter((i, tuple(c := sp.encode(t or "", add_eos=True)), sp.decode(c)) for i, t, *_ in TEXTS)
    assert got == want
    assert pieces.encode(empty, MODEL).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é▁\n\t中\u0000.😀")), max_size=40))
def test_word_table_equals_the_library(text):
    table = test_word_table_equals_the_library.table
    coded = [np.frombuffer(c, dtype=np.int32).tolist() for c in table.many([text, "a b", text[::-1]])]
    assert coded == [table.sp.encode(t) for t in (text, "a b", text[::-1])]


test_word_table_equals_the_library.table = pieces.WordTable(MODEL, limit=20)


def test_no_piece_crosses_a_marker():
    assert pieces.crossing_pieces(MODEL) == []


# Token counts


def test_counts_equal_the_library(docs, empty):
    tokenizer = Tokenizer.from_file(BYTES)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BYTES).collect())
    want = sorted(
        (i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in TEXTS
    )
    assert got == want
    assert token_counts.count_tokens(empty, BYTES).collect() == []


def test_counts_of_odd_texts(spark):
    """White space, apostrophes, digits, controls and special strings, drawn at random."""
    parts = ["a", "É", "'s", "'ll", "'", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "²", "9", "!", "<|endoftext|>", "—", " ", "ª"]
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(parts, r.integers(1, 12))) for _ in range(2000)]
    tokenizer = Tokenizer.from_file(BYTES)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in token_counts.count_tokens(df, BYTES).collect():
        assert row.n_tokens == len(tokenizer.encode(texts[row.doc_id], add_special_tokens=False)), repr(texts[row.doc_id])


def test_counts_in_every_script(spark):
    """Characters of all planes, alone and among Latin words, marks, white space and special strings."""
    r = np.random.default_rng(6)
    blocks = [(0x20, 0x24F), (0x300, 0x36F), (0x370, 0x5FF), (0x600, 0x77F), (0x900, 0xDFF), (0x1E00, 0x206F), (0x2070, 0x2BFF)]
    blocks += [(0x2E80, 0x33FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFFFD), (0x10000, 0x1FFFF), (0xE0000, 0xE01EF)]
    words = [" the", "word", " 'll", "  ", "\n\n ", "\u3000", "\u2028", "<|endoftext|>", " don't", "\u200d", "é", "12"]

    def piece():
        if r.random() < 0.4:
            return words[r.integers(len(words))]
        low, high = blocks[r.integers(len(blocks))]
        return "".join(chr(c) for c in r.integers(low, high + 1, r.integers(1, 5)))

    texts = ["".join(piece() for _ in range(r.integers(1, 14))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(BYTES)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_counts.count_tokens(df, BYTES).collect()
    for row in rows:
        assert row.n_tokens == len(tokenizer.encode(texts[row.doc_id], add_special_tokens=False)), repr(texts[row.doc_id])
    assert sum(row.n_whole > 0 for row in rows) > 2000


def test_texts_are_merged_together(monkeypatch):
    """One call of the library for many texts, and equal counts where the texts or the table are cut."""
    real = Tokenizer.from_file(BYTES)

    class Counted:
        calls = 0
        pre_tokenizer = real.pre_tokenizer
        to_str = real.to_str

        def encode_batch_fast(self, *args, **kwargs):
            Counted.calls += 1
            return real.encode_batch_fast(*args, **kwargs)

    texts = [f"Zq{i}xv unlikelywrd{i * i} the end 'll ²{i}" for i in range(200)] + [None, ""]
    want = [len(real.encode(t or "", add_special_tokens=False)) for t in texts]
    _, n_tokens, _ = token_counts.counter(Counted(), frozenset(token_counts.whole_tokens(BYTES)))([], texts)
    assert n_tokens.to_pylist() == want and Counted.calls == 1
    for name in ("HELD", "TABLE_TOKENS"):
        monkeypatch.setattr(token_counts, name, 10)
        assert token_counts.counter(Counted(), frozenset())([], texts)[1].to_pylist() == want


def test_whole_tokens_are_proved():
    tokenizer = Tokenizer.from_file(BYTES)
    whole = token_counts.whole_tokens(BYTES)
    assert len(whole) > 40_000
    assert all(len(tokenizer.encode(t, add_special_tokens=False)) == 1 for t in whole[::97])


# Mixture shards


def test_shards_match_the_mixture(spark, empty, docs):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(1000)]
    got = mixture.interleave(spark.createDataFrame(rows, "doc_id long, source string"), 8).collect()
    assert sorted(r.global_slot for r in got) == list(range(1000))
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(125))
        for source, n in Counter(s for _, s in rows).items():
            assert abs(sum(r.source == source for r in own) - n / 8) <= 1.5
    assert mixture.interleave(empty, 8).collect() == []
    assert mixture.interleave(docs, 8).count() == len(TEXTS)


# SimHash


def brute_fingerprint(text, words=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(j)] = find(i)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(prints))]


def test_simhash_classes(docs, empty):
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.classes(docs).collect())
    prints = [brute_fingerprint(t) for _, t, *_ in TEXTS]
    ids = [i for i, *_ in TEXTS]
    want = sorted((repr(i), simhash.signed(p), c) for i, p, c in zip(ids, prints, brute_components(prints, ids), strict=True))
    assert got == want
    assert simhash.classes(empty).collect() == []
    kept = simhash.one_per_class(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(c, p if c is None else 0) for _, p, c in want})


def test_links_connect_all_within_radius(spark):
    """Random fingerprints in tight balls, among them one hot ball of many different values."""
    r = np.random.default_rng(3)
    values = set()
    for centre, size, flips in [(int(r.integers(1 << 62)), 400, 3), *[(int(r.integers(1 << 62)), 6, 4) for _ in range(40)]]:
        for _ in range(size):
            x = centre
            for b in r.choice(64, r.integers(0, flips + 1), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    prints = sorted(values)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fingerprint long")
    found = {r.node: r.root for r in common.components(simhash.links(df)).collect()}
    signed = [simhash.signed(p) for p in prints]
    got = [found.get(p, p) for p in signed]
    assert got == brute_components(prints, signed)


@pytest.mark.parametrize("third", [0, 1, 2])
def test_large_bucket_without_all_pairs(third):
    """Members of one bucket, far more than are compared pairwise."""
    r = np.random.default_rng(third)
    bits = list(simhash.THIRDS[third])
    kept = [b for b in range(64) if b not in bits]
    values = {0}
    while len(values) < 300:
        x = sum(1 << int(b) for b in r.choice(bits[:9], r.integers(0, 5), replace=False))
        values.add(x ^ (1 << int(r.choice(kept)) if r.random() < 0.6 else 0))
    members = np.array(sorted(values), dtype=np.uint64)
    a, b = simhash.bucket_links(members, third)
    assert all(int(x ^ y).bit_count() <= 3 for x, y in zip(a, b, strict=True))
    linked = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in map(tuple, (p for p in linked if len(p) == 2)):
        root[find(x)] = find(y)
    erased = sum(1 << k for k in bits)
    for x, y in itertools.combinations(sorted(values), 2):
        apart, outside = (x ^ y).bit_count(), ((x ^ y) & ~erased).bit_count()
        if apart <= 3 and (outside <= 2 and apart - outside <= 1 or outside == 0):
            assert find(x) == find(y)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (5000, 5000)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


# Quality rules


def brute_measures(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + d for p in at.values() if len(p) > 1 for i in p for d in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures(spark, docs):
    junk = ["a b c d e f g h i a b c d e f g h i", "# $%\n# $%\n\n\n x", " ".join("ab" * 30), "p q " * 9, "\n".join(["l m"] * 5)]
    df = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.measured(df).select("doc_id", *[f"m.{n}" for n in names]).collect()
    texts = {i: t for i, t, *_ in TEXTS} | {100 + i: t for i, t in enumerate(junk)}
    for r in got:
        assert tuple(r)[1:] == brute_measures(texts[r.doc_id]), r.doc_id


def test_binomial_tail(spark):
    from math import comb, exp

    cases = [(0, 1, 0.1), (3, 50, 0.05), (10, 3000, 0.005), (50, 20_000, 0.005)]
    for k, n, p in cases:
        tail = quality_rules.log_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)
        got = spark.range(1).select(tail.alias("x")).first().x
        if n <= 3000:
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert exp(got) == pytest.approx(want, rel=1e-9)
        assert got < 0


def test_cutoffs_are_certified(spark, empty, docs):
    """Symbols mark bad texts: the rule goes on where holdouts suffice, and is off in a small stratum."""
    noise = ["", "###%%%"]
    rows = [(i, prose(40, i).replace(" ", noise[i % 5 == 0] + " "), "en" if i < 3000 else "fr") for i in range(3100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(3100)], "doc_id long, quality int, toxic int")
    kept = quality_rules.passing(df, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns
    assert ids == {i for i in range(3100) if i % 5 or i >= 3000}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    for marks in (none, odd):
        passed = [r.doc_id for r in quality_rules.passing(docs, marks).collect()]
        assert sorted(map(repr, passed)) == sorted(repr(i) for i, t, *_ in TEXTS if t and brute_keeps(t))
    assert quality_rules.passing(empty, none).collect() == []


def brute_keeps(text):
    n, _, _, _, again = brute_measures(text)
    return not (n < 20 or 100 * again > 30 * n)


# Line runs


def brute_runs(texts, least):
    """Lines that lie in a run of ``least`` words which came before."""
    lines = [t.split("\n") for t in texts]
    flat = [(d, p) for d, x in enumerate(lines) for p in range(len(x))]
    gone = set()
    for (d, p), (e, q) in itertools.combinations(flat, 2):
        n = 0
        while p + n < len(lines[d]) and q + n < len(lines[e]) and lines[d][p + n] == lines[e][q + n]:
            n += 1
        if sum(len(WORD.findall(lines[e][q + k])) for k in range(n)) >= least:
            gone |= {(e, q + k) for k in range(n)}
    return ["\n".join(x for p, x in enumerate(ls) if (d, p) not in gone) for d, ls in enumerate(lines)]


def test_line_runs_equal_brute_force(spark):
    r = np.random.default_rng(11)
    pool = ["", "a b c", "d", "e f", "g h i j", "k", " "]
    texts = ["\n".join(r.choice(pool, r.integers(1, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_lines) for x in line_runs.dedup(df, least_words=5).collect()}
    for i, want in enumerate(brute_runs(texts, 5)):
        assert got[i][1] == len(texts[i].split("\n"))
        assert got[i][0] == want, (i, texts[i])


def test_line_runs_of_odd_rows(docs, empty):
    got = line_runs.dedup(docs)
    assert got.count() == len(TEXTS)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[7] == LONG and texts[8] == "" and PASSAGE not in texts[2] and PASSAGE in texts[1]
    assert texts[4] == "" and texts[5] == ""
    changed = line_runs.without_runs(docs)
    assert changed.columns == docs.columns
    assert {r.doc_id: r.text for r in changed.collect()}[4] is None
    assert line_runs.dedup(empty).collect() == []


# Decontamination


def test_masks_lose_no_window():
    """Every choice of unequal words leaves some mask whole, for all window sizes."""
    masks = decontamination.MASKS
    for n in range(decontamination.LEAST_WORDS, decontamination.WINDOW + 1):
        laid = [sum(1 << (o + p) for p in m) for m in masks for o in range(n - m[-1])]
        for wrong in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            bad = sum(1 << w for w in wrong)
            assert any(not bad & m for m in laid), (n, wrong)


@pytest.mark.parametrize("few", [decontamination.FEW_SEEDS, 0])
def test_overlaps_with_substitutions(spark, docs, empty, monkeypatch, few):
    """Both join forms find what a word by word comparison finds."""
    monkeypatch.setattr(decontamination, "FEW_SEEDS", few)
    items = [(1, prose(30, 50)), (2, prose(12, 51)), (3, "too short"), (4, None), (5, prose(45, 52)), (5, prose(45, 52))]
    items += [(6, "solo"), (7, "one two three four five"), (8, "p q r s t u v"), (9, ""), (10, "never here")]
    texts, r = [], np.random.default_rng(2)
    for i in range(60):
        w = (items[[0, 1, 4][i % 3]][1]).split()
        for k in r.choice(len(w), r.integers(0, len(w) // 3), replace=False):
            w[k] = "other"
        texts.append((i, f"{prose(20, 60 + i)} {' '.join(w)} {prose(20, 200 + i)}".replace("a", "A")))
    short = ["x solo y", "Solo", "one two x four five", "two three four five six", "z one two three four", "one three two four five",
             "too\nshort", "too  x short", "p q r x t u v w", "p q x x t u v", "q r s t u v", "short too", "", "p q r s t u v solo"]
    texts += [(100 + i, t) for i, t in enumerate(short)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.matched) for x in decontamination.overlaps(df, tests).collect()}
    want = set()
    for i, t in texts:
        words = WORD.findall(t.lower())
        for item, text in items:
            q = (text or "").split()
            if not q:
                continue
            size = min(20, len(q))
            best = 0
            for shift in range(-len(q), len(words)):
                same = [0 <= shift + k < len(words) and words[shift + k] == q[k] for k in range(len(q))]
                best = max(best, *(sum(same[s : s + size]) for s in range(len(q) - size + 1)))
            if best * 5 >= 4 * size:
                want.add((i, item, best))
    assert got == want and len({g[0] for g in got}) > 20
    ids = {x.doc_id for x in decontamination.clean(df, tests).collect()}
    assert ids == {i for i, _ in texts} - {w[0] for w in want}
    assert decontamination.clean(docs, tests).columns == docs.columns
    assert decontamination.clean(docs, tests).count() == len(TEXTS)
    assert decontamination.overlaps(empty, tests).collect() == []
    assert decontamination.overlaps(df, tests.limit(0)).collect() == []


# Suffix spans


def brute_spans(texts):
    data = [(t or "").encode() for t in texts]
    n = suffix_spans.SPAN
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((bytes(b for b, g in zip(d, gone, strict=True) if not g), len(suffix_spans.runs(gone)[0])))
    return out


@pytest.mark.parametrize("split", [suffix_spans.SPLIT, 2])
def test_suffix_spans_equal_brute_force(docs, empty, monkeypatch, split):
    """Also with anchors split over shards, merged by binary search."""
    monkeypatch.setattr(suffix_spans, "SPLIT", split)
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in suffix_spans.dedup(docs).collect())
    texts = [t for _, t, *_ in TEXTS]
    want = Counter((x[0], len((x[1] or "").encode()), *b) for x, b in zip(TEXTS, brute_spans(texts), strict=True))
    assert got == want
    assert suffix_spans.dedup(empty).collect() == []


def test_suffix_spans_of_many_near_copies(spark):
    """Three thousand texts that differ from one in a word each, some in the same one: one anchor's regions fill many shards."""
    base, r = prose(170, 40).split(), np.random.default_rng(41)
    texts = []
    for n in range(3000):
        words = list(base)
        words[int(r.integers(len(words)))] = f"other{n if n % 3 else n % 30}"
        texts.append(" ".join(words).encode())
    seen = Counter(t[i : i + suffix_spans.SPAN] for t in texts for i in range(len(t) - suffix_spans.SPAN + 1))
    want = Counter()
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - suffix_spans.SPAN + 1):
            if seen[t[i : i + suffix_spans.SPAN]] > 1:
                gone[i : i + suffix_spans.SPAN] = True
        want[bytes(b for b, g in zip(t, gone, strict=True) if not g)] += 1
    df = spark.createDataFrame([(n, t.decode()) for n, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert Counter(bytes(x.kept) for x in suffix_spans.dedup(df).collect()) == want


@pytest.mark.parametrize("split", [suffix_spans.SPLIT, 3])
def test_suffix_spans_of_one_passage_in_many_texts(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_spans, "SPLIT", split)
    passage = prose(110, 70)
    texts = [f"{prose(30, 300 + i)} {passage[i % 7 :]} {prose(30, 900 + i)}" for i in range(120)] + ["zz " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_spans.dedup(df).collect()}
    assert got == {i: kept for i, (kept, _) in enumerate(brute_spans(texts))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=30), min_size=1, max_size=6))
def test_suffix_array_and_prefixes(parts):
    text = np.frombuffer(b"".join(p.encode() + b"\xff" for p in parts), dtype=np.uint8)
    stops = itertools.count(1000)
    letters = [next(stops) if c == 255 else c for c in text.tolist()]
    want = sorted(range(len(letters)), key=lambda i: letters[i:])
    order = suffix_spans.suffix_array(text)
    assert order.tolist() == want

    def shared(i, j):
        return sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(letters[i:], letters[j:], strict=False)))

    prefixes = suffix_spans.common_prefixes(text, order)
    assert prefixes.tolist() == [0, *(shared(a, b) for a, b in itertools.pairwise(want))]


# Training order


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_permutation_and_inverse(size, key):
    order = training_order.Permutation(size, key)
    slots = order.walk(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert order.walk(slots, back=True).tolist() == list(range(size))


def test_shards_round_trip(docs, empty, tmp_path):
    folder = f"file://{tmp_path}/shards"
    made = training_order.arranged(docs, MODEL, key=3, length=16, shard_records=50)
    rows = sorted(made.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 50 and r.offset == r.slot % 50 * 32 for r in rows)
    order = training_order.Permutation(len(rows), 3)
    assert sorted(order.walk(np.array([r.slot for r in rows]), back=True).tolist()) == list(range(len(rows)))
    for _ in range(2):  # a second run finds the shards there and leaves the same bytes
        written = sorted(training_order.write_shards(made, folder).collect(), key=lambda r: r.slot)
    assert [tuple(r)[:-2] for r in written] == [tuple(r) for r in rows]
    left = sorted(p.name for p in (tmp_path / "shards").iterdir())
    assert left == [f"{n:08d}.bin" for n in range(-(-len(rows) // 50))]
    for r in written:
        data = (tmp_path / "shards" / r.path.rsplit("/", 1)[1]).read_bytes()
        assert zlib.crc32(data) == r.shard_crc32 and data[r.offset : r.offset + 32] == bytes(r.record)
    read = training_order.read_records(folder, 30, 10**9, length=16, shard_records=50)
    assert [x.tobytes() for x in read] == [bytes(r.record) for r in rows[30:]]
    none = training_order.write_shards(training_order.arranged(empty, MODEL, key=3), f"{folder}-none")
    assert none.collect() == [] and len(training_order.read_records(f"{folder}-none", 0, 10)) == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {i: t for i, t, *_ in TEXTS}
    for i in (1, 4, 7, 12):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.seq_no)
        ids = [x for r in own for x in np.frombuffer(r.record, dtype="<u2")[: r.n_tokens].tolist()]
        assert ids == sp.encode(texts[i] or "", add_eos=True)
    assert training_order.arranged(empty, MODEL, key=3).collect() == []


# Toxicity


def test_folding():
    assert toxicity.fold("1D​I0T ìdíot іdiоt") == ["idiot", "ìdíot", "idiot"]
    assert toxicity.fold("a!b\n$cum") == ["a", "b", "scum"]


def test_lexicon_is_learned_and_held_out(spark, empty, docs):
    rows, labels = [], []
    for i in range(1500):
        w = prose(40, 5000 + i).split()
        if i % 6 == 0:
            w.insert(int(i % 37), ["vileword", "v1leword", "VILEWORDS,"][i % 3])
        if i % 9 == 1:
            w[5:5] = ["not", "nastyness"]
        if i % 9 == 0 and i % 6:
            w[int(i % 31)] = "nastyness"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0 or i % 9 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fitted(df, marks, F.col("doc_id") % 4 != 2)
    assert any(e.strip().startswith("vi") for e in lexicon.weights)
    toxic = {i for i, _, t in labels if t}
    held = [r for r in toxicity.scored(df, lexicon).collect() if r.doc_id % 4 == 2]
    assert sum((r.score >= 0.3) == (r.doc_id in toxic) for r in held) >= 0.95 * len(held)
    assert toxicity.scored(docs, lexicon).count() == len(TEXTS)
    assert toxicity.scored(empty, lexicon).collect() == []
    none = toxicity.fitted(df, marks.limit(0), F.lit(True))
    assert none.weights == {} and all(0 <= r.score < 0.01 for r in toxicity.scored(docs, none).collect())


def test_exceptions_excuse_an_entry():
    lexicon = toxicity.Lexicon({" viie ": 3.0, " vii": 2.0}, [" not viie "], 0.0, (-3.0, 2.0))
    assert toxicity.weighed(lexicon.automaton(), "so V1LE") == (3.0, 2)
    assert toxicity.weighed(lexicon.automaton(), "not vile but vile") == (3.0, 4)
    assert toxicity.weighed(lexicon.automaton(), None) == (0, 0)


# Toxicity, against a matcher without an automaton


def naive_weight(lexicon, text):
    """Every entry looked for at every place; a place inside an exception phrase doesn't count."""
    folded = f" {' '.join(toxicity.fold(text or ''))} "

    def places(entry):
        return [i for i in range(len(folded)) if folded.startswith(entry, i)]

    excused = [(i, i + len(p)) for p in lexicon.exceptions for i in places(p)]
    best = {}
    for entry, weight in lexicon.weights.items():
        for i in places(entry):
            if not any(a <= i and i + len(entry) <= b for a, b in excused):
                best[i] = max(weight, best.get(i, 0.0))
    return sum(best.values()), len(folded.split())


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sampled_from(["bad", "badly", "b4d", "BАD", "ba‍d", "very", "word", "ab", "a", "dab", "é"]), max_size=25).map(" ".join),
    st.dictionaries(st.sampled_from([" bad ", " badl", " ba", " word ", " very", " dab "]), st.floats(0.5, 5), max_size=6),
    st.sets(st.sampled_from([" bad word ", " very bad ", " word bad ", " bad bad "]), max_size=3),
)
def test_weights_equal_a_naive_matcher(text, weights, exceptions):
    lexicon = toxicity.Lexicon(weights=weights, exceptions=sorted(exceptions))
    got, want = toxicity.weighed(lexicon.automaton(), text), naive_weight(lexicon, text)
    assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9


def test_repeated_and_null_ids_in_learning(spark, monkeypatch):
    """An id on very many rows counts once per text and doesn't pass the bound; null ids have no label."""
    r = np.random.default_rng(9)
    docs = [(n, f"{prose(20, n)} {'vileword ' * (n % 2)}{prose(10, n + 5000)}", "en", "a", 1) for n in range(160)]
    docs += [(7, docs[7][1], "en", "a", 1)] * 300 + [(8, f"other {n}", "en", "a", 1) for n in range(300)] + [(None, "vileword", "en", "a", 1)] * 50
    labels = [(n, 1, n % 2) for n in range(160)] + [(7, 1, 1)] * 20 + [(None, 1, 1), (9, 1, None)]
    r.shuffle(docs)
    df, marks = spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 200)
    assert toxicity.labelled_sample(df, marks, F.lit(True)).count() == 200
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 1000)
    sample = toxicity.labelled_sample(df, marks, F.lit(True))
    assert sample.count() == 160 + 300 and sample.where("doc_id IS NULL").count() == 0
    lexicon = toxicity.fitted(df, marks, F.lit(True))
    assert any("viie" in e or "viiew" in e for e in lexicon.weights)  # l is folded to i
