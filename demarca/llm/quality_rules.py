"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule compares a share of the text with a cutoff. Cutoffs come from fixed grids, so
all labelled documents are a holdout. For each stratum and rule, a cutoff is certified if
an exact binomial test says that it rejects at most ``risk`` of the good documents, at a
level divided by the number of strata and rules (Bonferroni). Along a grid the tests are
nested, a laxer cutoff never fails where a stricter one passes, so a grid costs one test
(fixed sequence). Of the certified cutoffs the most useful one is used; where none is
certified, or none helps, the rule is off in that stratum.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import BLANKS, let, stored, words

#: Words of a window that must not come twice.
WINDOW = 8

#: rule -> (counted, out of, cutoffs per mille from lax to strict); more than the cutoff is rejected.
RULES = {
    "symbols": ("n_symbols", "word_chars", (500, 400, 300, 200, 150, 100, 50)),
    "repeated_lines": ("n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 400, 300)),
    "repeated_words": ("n_repeat_words", "n_words", (300, 250, 200, 150, 100)),
    "capitals": ("n_capitals", "word_chars", (800, 700, 600, 500, 400, 300)),
}


@dataclass(frozen=True)
class Risk:
    """``risk``: share of good documents a rule may reject; ``level``: chance that any bound fails."""

    risk: float = 0.005
    level: float = 0.05
    #: Good documents that must not be lost for one bad document rejected, when cutoffs are compared.
    price: int = 20


def repeated_words(w: Column) -> Column:
    """Words in windows that come twice or more in the text, the first ones included.

    Windows are compared by 64-bit hashes. Most texts repeat none, which the distinct
    count shows; for the others, equal hashes meet in sorted order and the windows found
    are united from left to right.
    """

    def cover(h: Column) -> Column:
        both = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def met(x: Column, i: Column) -> Column:
                near = [F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
                return near[0] | near[1]

            return F.sort_array(F.transform(F.filter(s, met), lambda x: x["i"]))

        def add(acc: Column, i: Column) -> Column:
            new = i + WINDOW - F.greatest(i, acc["end"])
            return F.struct((acc["n"] + new).alias("n"), (i + WINDOW).alias("end"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(both, twice), zero, add, lambda acc: acc["n"])

    def found(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(cover(h))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(let(hashes, found))


def measures(text: Column) -> Column:
    """Counts of a whole text as one struct of longs; a null text counts like an empty one."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, x = let(words(text), of_words), let(lines, of_lines)
    parts = {
        "n_words": w["n_words"],
        "word_chars": F.length(F.regexp_replace(text, BLANKS, "")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": x["dup"],
        "n_repeat_words": w["n_repeat_words"],
        "n_lines": x["n"],
        "n_capitals": F.length(F.regexp_replace(text, r"[^A-ZÀ-ÖØ-Þ]+", "")),
    }
    return F.struct(*[v.cast("long").alias(k) for k, v in parts.items()])


def base_failed(m: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def rejects(m: Column, rule: str, cutoff: Column) -> Column:
    """Whether a rule rejects at a cutoff per mille; on whole numbers, so nothing is rounded."""
    counted, out_of, _ = RULES[rule]
    return 1000 * m[counted] > cutoff * m[out_of]


def log_tail(k: Column, n: Column, p: float) -> Column:
    """Logarithm of P(X <= k) for X binomial (n, p): the exact sum, from the recurrence of its terms."""
    first = n * log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + log(p / (1 - p))
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda acc: acc["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, limit: Risk = Risk()) -> DataFrame:
    """Rows (stratum, rule, cutoff, good, good_lost, bad_caught) of the rules that are on.

    ``measured`` has doc_id, stratum and m; ``labels`` has doc_id and quality, 1 for good.
    A document with several labels is good if all of them say so. Null labels and labels
    of unknown documents don't count. Counts per stratum are one aggregate.
    """
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality IS NOT NULL")
    known = measured.join(marks, "doc_id")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    tests = [(r, c) for r, (_, _, grid) in RULES.items() for c in grid]
    sums = [
        F.struct(
            F.lit(r).alias("rule"),
            F.lit(c).cast("long").alias("cutoff"),
            F.count_if(good & rejects(F.col("m"), r, F.lit(c))).alias("good_lost"),
            F.count_if(bad & rejects(F.col("m"), r, F.lit(c))).alias("bad_caught"),
        )
        for r, c in tests
    ]
    counted = known.groupBy("stratum").agg(F.count_if(good).alias("good"), F.array(*sums).alias("tests"))
    counted = counted.where("good > 0")
    rows = counted.select("stratum", "good", F.inline("tests"))
    level = log(limit.level / max(counted.count() * len(RULES), 1))
    hopeful = F.col("good_lost") < F.col("good") * limit.risk
    certified = F.when(hopeful, log_tail(F.col("good_lost"), F.col("good"), limit.risk) <= level)
    gain = F.col("bad_caught") - limit.price * F.col("good_lost")
    best = F.max(F.struct(gain.alias("gain"), "cutoff", "good", "good_lost", "bad_caught")).alias("best")
    chosen = rows.where(certified & (gain > 0)).groupBy("stratum", "rule").agg(best)
    return chosen.select("stratum", "rule", *[f"best.{c}" for c in ("cutoff", "good", "good_lost", "bad_caught")])


#: Strata whose cutoffs are sent to every task; with more of them the join is left to measured sizes.
FEW_STRATA = 10_000


def judged(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` (with stratum and m) plus ``base_failed``, ``failed_rules`` and ``kept``."""
    wide = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    wide = wide.withColumnRenamed("stratum", "_stratum")
    if chosen.limit(FEW_STRATA + 1).count() <= FEW_STRATA:
        wide = F.broadcast(wide)
    met = docs.join(wide, F.col("stratum") == F.col("_stratum"), "left")
    m = F.col("m")
    failed = [F.when(rejects(m, r, F.try_element_at("_cut", F.lit(r))), r) for r in RULES]
    met = met.withColumns({"base_failed": base_failed(m), "failed_rules": F.concat_ws(",", *failed)})
    return met.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("_stratum", "_cut")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Rows (doc_id, stratum, m); a null stratum is one of its own, named by an empty text."""
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"),
        measures(F.col(f"`{text}`")).alias("m"),
    )


def passing(docs: DataFrame, labels: DataFrame, limit: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Cutoffs are fitted on the labelled documents among ``docs``. Texts are measured again
    where they are, so no text is shuffled. Null or empty texts fail the base rule; repeats
    are judged alike; without labels only the base rule is on.
    """
    chosen = stored(cutoffs(stored(measured(docs)), labels, limit))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum")
    rows = judged(docs.select(own, stratum, measures(F.col("text")).alias("m")), chosen)
    return rows.where("kept").select("own.*")
