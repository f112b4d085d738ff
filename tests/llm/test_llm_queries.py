"""The registered queries and the pipeline on the smallest driver tables, against DuckDB or brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_llm_operators import WORD, brute_components, brute_fingerprint, brute_keeps, brute_runs, brute_spans
from test_near_copies import brute_classes
from tokenizers import Tokenizer

from demarca.llm import decontamination, line_runs, training_order
from demarca.llm.queries import ORACLE, QUERIES
from workbench.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_one_query_per_operator():
    import __spark_entry__

    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_twin(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_line_runs", "op8_decontamination"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_op1(spark, texts):
    rows = QUERIES["op1_toxicity"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def brute_slot(number, size, keys):
    """The network on Python integers, walked until it is inside."""
    half = (max(2, (max(size, 1) - 1).bit_length()) + 1) // 2
    word, mask = (1 << 64) - 1, (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for key in keys:
            x = (right + key) * 0x9E3779B97F4A7C15 & word
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & word
            left, right = right, left ^ ((x ^ x >> 32) & mask)
        number = left << half | right
        if number < size:
            return number


def test_op2_slots_by_an_independent_walk():
    for size in (1, 2, 3, 1000, 4097):
        order = training_order.Permutation(size, 2026)
        want = [brute_slot(n, size, [int(k) for k in order.keys]) for n in range(size)]
        assert order.walk(np.arange(size)).tolist() == want


def test_op2(spark, texts):
    rows = QUERIES["op2_training_order"](spark, SMALL).collect()
    shards = {r.path: r.shard_crc32 for r in rows}
    assert {p: zlib.crc32(open(p, "rb").read()) for p in shards} == shards
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids = defaultdict(dict)
    for r in rows:
        assert len(r.record) == 2 * training_order.LENGTH
        ids[r.doc_id][r.seq_no] = np.frombuffer(r.record, dtype="<u2")[: r.n_tokens]
    for i, parts in ids.items():
        assert np.concatenate([parts[k] for k in sorted(parts)]).tolist() == SP.encode(texts[i], add_eos=True)


def test_op5(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op5_suffix_spans"](spark, SMALL).collect()}
    for (i, text), (kept, spans) in zip(texts.items(), brute_spans(texts.values()), strict=True):
        n = len(text.encode())
        assert tuple(rows[i]) == (i, n, n - len(kept), spans, sha(kept))


def test_op6(spark, texts):
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_sentencepiece"](spark, SMALL).collect()}
    for i, text in texts.items():
        ids = SP.encode(text, add_eos=True)
        assert rows[i] == (len(ids), sha(" ".join(map(str, ids))), sha(SP.decode(ids)))


def test_op9(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op9_token_counts"](spark, SMALL).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_op10(spark, texts):
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_classes"](spark, SMALL).collect()}
    prints = [brute_fingerprint(t) for t in texts.values()]
    for i, p, c in zip(texts, prints, brute_components(prints, list(texts)), strict=True):
        assert rows[i] == (f"{p:016x}", c)


def brute_leaks(texts, items):
    """Documents in which a window of an item recurs with four fifths of its words."""
    where, found = defaultdict(list), set()
    words = {i: WORD.findall((t or "").lower()) for i, t in items.items()}
    for i, w in words.items():
        for k, x in enumerate(w):
            where[x].append((i, k))
    for d, text in texts.items():
        laid = defaultdict(list)
        for p, x in enumerate(WORD.findall(text.lower())):
            for i, k in where.get(x, ()):
                laid[i, p - k].append(k)
        for (i, _), places in laid.items():
            n = len(words[i])
            size = min(n, decontamination.WINDOW)
            if len(places) * 5 >= 4 * size:
                starts = [min(s, n - size) for s in places]
                if max(sum(s <= k < s + size for k in places) for s in starts) * 5 >= 4 * size:
                    found.add(d)
    return found


def test_pipeline_equals_brute_force(spark, texts):
    """No rule has enough labels here to be certified, so the first stage is the base rule."""
    left = {i: t for i, t in sorted(texts.items()) if brute_keeps(t)}
    left = dict(zip(left, brute_runs(list(left.values()), line_runs.LEAST_WORDS), strict=True))
    classes = brute_classes(list(left.items()))
    left = {i: t for (i, t), c in zip(left.items(), classes, strict=True) if i == c}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    leaks = brute_leaks(left, items)
    want = Counter((i, tuple(SP.encode(t, add_eos=True)), t) for i, t in left.items() if i not in leaks)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and leaks


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SMALL).columns == docs.columns
