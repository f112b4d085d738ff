"""Near copies of the pipeline's stage against a comparison of all pairs."""

import itertools
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_llm_operators import WORD, brute_fingerprint, prose

from demarca.llm import near_copies


def brute_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_classes(rows):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def edited(text, n, r):
    w = text.split()
    for k in r.choice(len(w), n, replace=False):
        w[k] = f"w{r.integers(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small, piece, sheaf", [(16, 4096, 256), (2, 8, 4)])
def test_classes_against_all_pairs(spark, monkeypatch, small, piece, sheaf):
    """Similarities around the threshold, a hot group, copies, odd texts: no wrong link, few are missed."""
    monkeypatch.setattr(near_copies, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_copies, "PIECE", piece)
    monkeypatch.setattr(near_copies, "SHEAF", sheaf)
    r = np.random.default_rng(4)
    base = [prose(int(r.integers(5, 250)), 900 + i) for i in range(40)]
    texts = [t for b in base for t in (b, edited(b, int(r.integers(0, 1 + len(b.split()) // 20)), r))]
    texts += [edited(prose(120, 990), int(r.integers(1, 7)), r) for _ in range(60)]
    texts += [texts[0], texts[0].upper().replace(" ", "\n"), None, "", " \t", "a", "A", "a b c", "a b c d e", prose(300, 991)]
    texts += [f"{texts[-1]} {prose(40, 992)}", "x x x x x", "x x x x x x x"]
    rows = [*enumerate(texts), (None, texts[1]), (None, prose(20, 993)), (None, None)]
    got = near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    got = {x.doc_id: x.component_id for x in got if x.doc_id is not None}
    want = dict(zip((i for i, _ in rows), brute_classes(rows), strict=True))
    assert all(want[i] == want[c] for i, c in got.items())
    copies = len(texts) - len({want[i] for i in range(len(texts))})
    assert copies > 20 and len(texts) - len(set(got.values())) >= 0.9 * copies
    same = [(0, 80 + 60), (142, 143), (143, 144), (145, 146)]  # equal but for case and white space
    assert [(i, j) for i, j in same if got[i] != got[j]] == []
    assert got[len(texts) - 1] == got[len(texts) - 2]
    assert near_copies.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recall_by_similarity(spark):
    """Copies changed by single words, held against their bands; each base text and its copy are apart from the rest."""
    r, rows, band = np.random.default_rng(6), [], {}
    for i in range(300):
        text = prose(int(r.integers(60, 400)), 2000 + i)
        copy = edited(text, int(r.integers(1, 2 + len(text.split()) // 40)), r)
        a, b = brute_set(text), brute_set(copy)
        band[2 * i] = len(a & b) / len(a | b)
        rows += [(2 * i, text), (2 * i + 1, copy)]
    got = {x.doc_id: x.component_id for x in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [i for i, j in band.items() if low <= j < high]
        assert len(own) > 20 and sum(got[i + 1] == i for i in own) >= 0.95 * len(own)
    assert all(got[i] == i and got[i + 1] == i + 1 for i, j in band.items() if j < 0.8)


def flipped(one, n, r):
    out = one.copy()
    for k in r.choice(128, n, replace=False):
        out[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    return out


def test_eleven_bits_always_meet(spark):
    """Small buckets lose no pair within eleven bits: some part of the four differs in two bits or fewer."""
    r = np.random.default_rng(7)
    first = r.integers(0, 2**64, (200, 2), dtype=np.uint64)
    both = np.concatenate([first, [flipped(x, int(r.integers(1, 12)), r) for x in first]]).view(np.int64)
    prints = [(int(a), int(b), i) for i, (a, b) in enumerate(both)]
    met = near_copies.candidates(spark.createDataFrame(prints, "first long, second long, node long")).collect()
    assert {(i, i + 200) for i in range(200)} <= {(min(x), max(x)) for x in met}


def test_hubs_stay_linear():
    """A bucket of near copies of one fingerprint: rows grow with its members, all members are connected."""
    r = np.random.default_rng(8)
    middle, rows = r.integers(0, 2**64, 2, dtype=np.uint64), []
    for n in (500, 1000, 2000):
        members = np.unique([flipped(middle, int(r.integers(0, 5)), r) for _ in range(n)], axis=0)
        a, b, hubs = near_copies.at_hubs(members, near_copies.NONE)
        assert len(hubs) == 1 and {tuple(x) for x in b} | {tuple(hubs[0])} == {tuple(x) for x in members}
        rows.append(len(a) / len(members))
    assert max(rows) <= 1


def test_stage_drops_near_copies_of_far_fingerprints(spark):
    """Pairs of similarity 0.8 that differ in more than three bits of op10's fingerprint."""
    r, rows = np.random.default_rng(5), []
    for i in range(12):
        text = prose(200, 800 + i)
        rows += [(2 * i, text, "en", "a", 1), (2 * i + 1, edited(text, 3, r), "en", "a", 1)]
    far = [a[0] for a, b in zip(rows[::2], rows[1::2], strict=True) if (brute_fingerprint(a[1]) ^ brute_fingerprint(b[1])).bit_count() > 3]
    assert far
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(x.doc_id for x in left.collect()) == list(range(0, 24, 2))


@pytest.mark.parametrize("piece, strip", [(4096, 256), (8, 3)])
def test_large_buckets_lose_no_link(spark, monkeypatch, piece, strip):
    """Near copies of each other that all meet at one hub, to which they are less similar than the threshold."""
    monkeypatch.setattr(near_copies, "PIECE", piece)
    monkeypatch.setattr(near_copies, "STRIP", strip)
    r, base = np.random.default_rng(9), prose(400, 950)
    texts = [edited(base, 1, r) for _ in range(40)]
    for _ in range(15):
        one = edited(base, 10, r)
        texts += [one, edited(one, 1, r), " ".join(reversed(one.split())), " ".join(reversed(edited(one, 1, r).split()))]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert len(set(want)) > 25 and [got[i] for i in range(len(rows))] == want


def test_least_shared_spot():
    """The least common one of the spots that two members emit, or none."""
    r = np.random.default_rng(10)
    a = np.array([[r.integers(0, 2**64, dtype=np.uint64) * (i % 7 > 0), r.integers(0, 2**64, dtype=np.uint64), i] for i in range(300)], dtype=np.uint64)
    b = np.array([[*flipped(x[:2], int(r.integers(0, 14)), r), 0] for x in a], dtype=np.uint64)

    def spots(row):
        values = [int(row[k // 2]) >> (32 if k % 2 == 0 else 0) & 0xFFFFFFFF for k in range(4)]
        return {part << 32 | v ^ flip for part, v in enumerate(values) for flip in (0, *(1 << k for k in range(32)))}

    assert near_copies.least_spot(a, b).tolist() == [min(spots(x) & spots(y), default=-1) for x, y in zip(a, b, strict=True)]


def test_large_buckets_make_few_pairs(spark, monkeypatch):
    """Near copies too far apart to link, and a family that links but for its hub: pairs grow with texts, not their square."""
    r, base, pairs, find = np.random.default_rng(11), prose(150, 960), [], near_copies.links

    def counted(some, known):
        pairs.append(some.count())
        return find(some, known)

    monkeypatch.setattr(near_copies, "links", counted)
    one = edited(base, 6, r)
    texts = [base] * 2 + [edited(base, 6, r) for _ in range(200)] + [edited(one, 1, r) for _ in range(100)]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert 100 < len(set(want)) <= 202 and [got[i] for i in range(len(rows))] == want
    assert sum(pairs[1:]) <= 2 * len(texts)


def test_sketches_lose_no_link():
    """Sets of any two sizes around the threshold pass where they link; sets far from it do not."""
    r, passed, linked = np.random.default_rng(12), 0, 0
    for _ in range(400):
        n = int(r.integers(1, 700))
        pool = np.unique(r.integers(-(2**63), 2**63, 2 * n + 20, dtype=np.int64))
        a = pool[: n + 1]
        b = np.sort(np.r_[a[int(r.integers(0, 2 + n // 5)) :], pool[n + 1 : n + 1 + int(r.integers(0, 1 + n // 8))]])
        both = len(np.intersect1d(a, b))
        links = 5 * both >= 4 * (len(a) + len(b) - both)
        size = tuple(np.array([len(x)]) for x in (a, b))
        at = np.zeros(1, dtype=np.int64)
        may = near_copies.may_link(at, at, size, tuple([near_copies.sketch(x)] for x in (a, b)), {})[0]
        assert may or not links
        passed, linked = passed + may, linked + links
    assert 50 < linked < 350 and passed < 1.2 * linked


def test_spanning_pairs_connect_the_same():
    """Pairs let through connect what all pairs do, and none closes a ring."""
    roots = np.array([10, 11, 12, 13, 13, 14], dtype=np.uint64)
    kept = near_copies.Roots(roots)
    i, j = kept.spanning(roots[:3], np.array([0, 0, 0, 1, 2]), np.array([1, 3, 4, 0, 1]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (0, 3), (2, 1)]
    i, j = kept.spanning(roots[4:], np.array([0, 1, 1]), np.array([2, 2, 5]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(1, 2)]
    assert [x.tolist() for x in kept.spanning(roots, np.array([], dtype=int), np.array([], dtype=int))] == [[], []]
