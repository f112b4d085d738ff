"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding undoes disguises: case, wide and joined forms, look-alike letters of other
alphabets and digits for letters. Accented letters stay, they tell words apart. The lexicon (words and word beginnings), its weights, the phrases that excuse an entry and the
score's curve are learned from labelled documents; a text's weight is normalised by its
length.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import by_slice, keyed, stored

#: Letters of other alphabets that look like Latin ones, in alphabetical order.
LOOK_ALIKES = {
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "а": "a", "в": "b", "г": "r", "е": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ь": "b", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u",
}

#: Digits and signs written for letters. The letter l joins i, as 1 stands for both.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i", "@": "a", "$": "s"}

#: Labelled documents that the lexicon and the curve are learned from, at most; taken by hash.
MOST_LABELLED = 30_000

#: Entries of the lexicon, exception phrases and candidates of either, at most.
MOST_ENTRIES, MOST_EXCEPTIONS, MOST_CANDIDATES = 5_000, 5_000, 100_000

#: Lengths of word beginnings that may be entries; whole words have three letters or more.
STEMS = range(4, 9)

#: Different neighbourhoods an entry needs in toxic documents, so that copies of one text prove nothing.
LEAST_SEEN = 5

#: Lower bound (two standard errors) that the log odds ratio of an entry must exceed.
LEAST_ODDS = 1.0


class Folding(dict):
    """A ``str.translate`` table, filled as characters come up; what is no letter becomes a space."""

    def __missing__(self, code: int) -> str:
        base = [LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKC", chr(code)).lower()]
        base = [SUBSTITUTES.get(c, c) for c in base]
        hidden = unicodedata.category(chr(code)) in ("Cf", "Mn")  # joiners and loose accents inside a word
        folded = "" if hidden else "".join(c if c.isalpha() else " " for c in base) or " "
        self[code] = folded
        return folded


FOLDING = Folding()


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    return text.translate(FOLDING).split()


def entries(word: str) -> Iterator[str]:
    """What a word may be listed as: whole (with a space after it) and its beginnings."""
    if len(word) >= 3:
        yield f" {word} "
    for n in STEMS:
        if len(word) >= n:
            yield f" {word[:n]}"


@dataclass
class Lexicon:
    """Weights of entries, phrases that excuse an entry, and the score's curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.0  # of the length that divides the weight
    curve: tuple[float, float] = (-20.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        """Entries with their weights, exception phrases with None."""
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        made.make_automaton()
        return made

    def score(self, weight: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Probability of toxicity from the summed weight and the number of words."""
        load = np.log1p(weight / np.maximum(n_words / 100, 0.01) ** self.power)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * load)))


def hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries in a folded text that lie in no exception phrase."""
    if not len(automaton):
        return []
    found = [(end + 1 - n, end + 1, w) for end, (n, w) in automaton.iter(text)]
    excused = sorted((a, b) for a, b, w in found if w is None)
    found = [x for x in found if x[2] is not None]
    if not excused:
        return found
    starts = [a for a, _ in excused]
    reach = list(accumulate((b for _, b in excused), max))  # the furthest end of the phrases up to each start

    def free(start: int, end: int) -> bool:
        at = bisect_right(starts, start)
        return not at or reach[at - 1] < end

    return [x for x in found if free(x[0], x[1])]


def weighed(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
    """Summed weight and number of words; of entries that start together only the heaviest counts."""
    folded = fold(text or "")
    best: dict[int, float] = {}
    for start, _, w in hits(automaton, f" {' '.join(folded)} "):
        best[start] = max(w, best.get(start, 0.0))
    return sum(best.values()), len(folded)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """Rows (doc_id, text, toxic, part) of at most ``MOST_LABELLED`` labelled documents, by hash of the id.

    A document is toxic if any of its labels says so. ``part`` 0 and 1 learn the lexicon,
    2 the curve. Rows that repeat an id and its text are one document, null ids have no
    label. An id of many texts counts with each, within the bound. The ids, and then the
    documents, are bounded in number, so they go to every task; texts stay where they are.
    """
    marks = labels.where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mix = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    few = marks.withColumn("mix", mix).orderBy("mix", "doc_id").limit(MOST_LABELLED)
    part = F.pmod("mix", F.lit(3)).cast("int").alias("part")
    met = keyed(docs).join(F.broadcast(few), "doc_id").select("doc_id", "text_key", "text", "toxic", "mix", part)
    once = stored(met.groupBy("doc_id", "text_key", "toxic", "mix", "part").agg(F.min("text").alias("text")))
    taken = once.select("doc_id", "text_key", "mix").orderBy("mix", "text_key", "doc_id").limit(MOST_LABELLED).drop("mix")
    return once.join(F.broadcast(taken), ["doc_id", "text_key"]).select("doc_id", "text", "toxic", "part")


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, place) of toxic texts: each entry with a hash of its neighbours."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            w = ["", *fold(text), ""]
            for before, word, after in zip(w, w[1:], w[2:], strict=False):
                place = xxhash.xxh64_intdigest(f"{before} {after}") >> 1
                seen.update((e, place) for e in entries(word))
    yield pa.RecordBatch.from_pylist(
        [{"entry": e, "place": p} for e, p in seen], schema=pa.schema([("entry", pa.string()), ("place", pa.int64())])
    )


def frequencies(known: frozenset[str]):
    """Texts that hold each known entry, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update({e for w in set(fold(text)) for e in entries(w) if e in known})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"]
        )

    return run


def phrases(lexicon: Lexicon):
    """(phrase, toxic, n) around entries: the entry's word with the word before or after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = lexicon.automaton(), defaultdict(int)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, found = f" {' '.join(fold(text))} ", set()
                for start, end, _ in hits(automaton, folded):
                    stop = folded.index(" ", start + 1) + 1
                    if start > 0:
                        found.add(folded[folded.rfind(" ", 0, start) : max(stop, end)])
                    if (after := folded.find(" ", stop)) > 0:
                        found.add(folded[start : after + 1])
                for phrase in found:
                    counts[phrase, toxic] += 1
        rows = [{"phrase": p, "toxic": t, "n": n} for (p, t), n in counts.items()]
        kinds = [("phrase", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return run


def fitted(docs: DataFrame, labels: DataFrame, usable: Column) -> Lexicon:
    """Learn a lexicon from the labelled documents for which ``usable`` holds; no toxic ones give an empty one.

    Repeated rows, repeated labels and null ids do no harm: see ``labelled_sample``.
    """
    sample = stored(labelled_sample(docs, labels, usable))
    learn, curve = sample.where("part < 2"), sample.where("part = 2")
    toxic, other = learn.where("toxic = 1"), learn.where("toxic = 0")
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic or not n_other:
        return Lexicon()
    places = toxic.select("text").mapInArrow(candidates, "entry string, place long").distinct()
    counted = places.groupBy("entry").count().where(F.col("count") >= LEAST_SEEN)
    seen = dict(counted.orderBy(F.desc("count"), "entry").limit(MOST_CANDIDATES).collect())
    count = frequencies(frozenset(seen))
    held = [x.select("text").mapInArrow(count, "entry string, n long") for x in (toxic, other)]
    bad, good = (dict(x.groupBy("entry").agg(F.sum("n")).collect()) for x in held)  # one row per candidate at most
    lexicon = Lexicon(weights=chosen({e: min(n, bad[e]) for e, n in seen.items()}, good, n_toxic, n_other))
    around = learn.select("text", "toxic").mapInArrow(phrases(lexicon), "phrase string, toxic int, n long")
    both = around.groupBy("phrase").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )
    excused = both.where((F.col("good") >= 5) & (F.col("good") >= 20 * F.col("bad")))
    excused = excused.orderBy(F.desc("good"), "phrase").limit(MOST_EXCEPTIONS)
    lexicon.exceptions = sorted(r.phrase for r in excused.collect())
    rows = scored(curve.select(F.struct("doc_id", "toxic").alias("doc_id"), "text"), lexicon)
    table = rows.select("weight", "n_words", "doc_id.toxic").toPandas()  # a third of the bounded sample
    lexicon.power, lexicon.curve = calibrated(table["weight"].to_numpy(), table["n_words"].to_numpy(), table["toxic"].to_numpy())
    return lexicon


def chosen(seen: dict[str, int], against: dict[str, int], n_toxic: int, n_other: int) -> dict[str, float]:
    """Entries whose log odds ratio is surely high, with it as weight.

    A beginning makes its longer forms needless, unless one of them is seen at least half
    as often and is clearly surer; then the beginning also starts harmless words and goes.
    """
    odds = {}
    for entry, t in seen.items():
        n = against.get(entry, 0)
        ratio = np.log((t + 0.5) / (n_toxic - t + 0.5)) - np.log((n + 0.5) / (n_other - n + 0.5))
        if ratio - 2 * np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5)) > LEAST_ODDS:
            odds[entry] = float(ratio)
    within = {e: [e[:n] for n in range(1 + STEMS[0], len(e)) if e[:n] in odds] for e in odds}
    vague = {b for e, longer in within.items() for b in longer if odds[e] > odds[b] + 1 and 2 * seen[e] >= seen[b]}
    short = {e for e in odds if e not in vague and all(b in vague for b in within[e])}
    return dict(sorted(((e, odds[e]) for e in short), key=lambda x: (-x[1], x[0]))[:MOST_ENTRIES])


def calibrated(weight: np.ndarray, n_words: np.ndarray, toxic: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Length power and logistic curve of greatest likelihood, lightly shrunk, by Newton steps."""
    best = (np.inf, 0.0, (-20.0, 0.0))
    for power in (0.0, 0.25, 0.5, 0.75, 1.0):
        x = np.log1p(weight / np.maximum(n_words / 100, 0.01) ** power)
        design, b = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ b))
            pull = design.T @ (toxic - p) - 0.1 * b
            bend = design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
            b = b + np.linalg.solve(bend, pull)
        p = np.clip(1 / (1 + np.exp(-design @ b)), 1e-9, 1 - 1e-9)
        loss = -np.sum(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)) + 0.05 * b @ b
        if loss < best[0]:
            best = (loss, power, (float(b[0]), float(b[1])))
    return best[1], best[2]


def scored(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, weight, n_words, score) of every whole text.

    Only the text is read. Null, empty and wordless texts have weight 0 and the score of
    that weight. One row per input row, repeats and null ids included; no rows give none.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        automaton = lexicon.automaton()

        def work(ids, texts):
            found = [weighed(automaton, t) for t in texts]
            weight, size = (np.array([x[k] for x in found], dtype=float) for k in (0, 1))
            return [pa.array(weight), pa.array(size.astype(np.int64)), pa.array(lexicon.score(weight, size))]

        return work

    run = by_slice(["doc_id", "text"], make, ["doc_id", "weight", "n_words", "score"])
    return rows.mapInArrow(run, f"doc_id {kind}, weight double, n_words long, score double")
