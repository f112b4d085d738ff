"""URL filter: rules on hosts and paths first, then a logistic regression on hashed character n-grams.

The model reads host and path only. Their n-grams of three to five characters, with marks
at both ends, are hashed into a fixed number of buckets, so the model has one size whatever
it was trained on. It is trained here, from a small table of labelled URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams, and the bits of a bucket number.
GRAMS, BITS = (3, 4, 5), 17

#: Labelled URLs that the model is trained from, at most; more of them raise.
MOST_LABELLED = 20_000

#: Newton's method on the rows, at most so many steps; ridge penalty of the weights.
STEPS, PENALTY = 30, 0.005

#: Subjects of sites that a training corpus doesn't want, and of sites that it does, in alphabetical order.
UNWANTED = """
    adult ads adserver adware affiliate bet bets betting bingo blackjack bonus camgirls casino cheap cialis clicks
    coupon crack cracked dating discount download escort farm fake free gambling hack hookup jackpot keygen
    linkfarm loans lottery malware meds nude nudes payday pharmacy phishing pills poker popup porn promo
    replica roulette sex sexy slots spam spyware sportsbook steroids torrent track tracker tracking traffic
    viagra vids warez webcam weightloss win winner xxx x
""".split()
WANTED = """
    academy archive arts astronomy author bakery biology botany bridge building chemistry church city clothing
    college community cooking council country daily design doctor drama education engineering farmers fishing forest garden gazette geology
    government health heritage history hospital house institute journal kitchen language law lecture library
    literature magazine math medicine mountain museum music nation nature news notes novel ocean opera
    orchard painting parish physics poetry policy press project radio reading recipes research review river
    school science season society station story student studio teacher teaching theatre thesis tours town travel
    tutorial university village weather winter writing
""".split()
SUBDOMAINS, ENDINGS = ("", "www.", "m.", "blog."), ("com", "net", "org", "info")
PATHS = ("/", "/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/{w}/{n}", "/index.html", "/articles/{w}-{n}")

#: A rule is (host, path).
Rule = tuple[str, str]


def sample_urls() -> list[tuple[str, int]]:
    """The default labelled table, (url, blocked): every subject alone and beside two others, on two pages each.

    Both classes are written with the same subdomains, endings and paths, which so carry no weight.
    """
    found = []
    for blocked, subjects in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(subjects):
            for j, other in enumerate((None, subjects[(i + 7) % len(subjects)], subjects[(i + 31) % len(subjects)])):
                name = word if other is None else f"{word}{'-' if (i + j) % 3 else ''}{other}"
                for turn in (2 * (3 * i + j), 2 * (3 * i + j) + 1):
                    path = PATHS[turn % len(PATHS)].format(n=97 * turn + 11, w=word)
                    found.append((f"https://{SUBDOMAINS[turn % 4]}{name}.{ENDINGS[turn // 4 % 4]}{path}", blocked))
    return found


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); empty without ``://`` or URL."""
    found = [F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2)]
    return F.translate(found[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found[1]


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as text, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of rules
    of one length the one with the longer host wins, then the first in the alphabet. The
    rules are part of the plan, so they should be some hundreds at most.
    """
    by_length = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for h, p in by_length]
    named = [F.when(fit, F.lit(h + p)) for fit, (h, p) in zip(fits, by_length, strict=True)]
    return F.coalesce(*named, F.lit(None).cast("string"))


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, share) of all n-grams of hosts and paths; a row's shares have length one in all.

    Host and path are told apart by their marks; an empty host and path have no n-grams.
    """
    marked = [f"\x01{h}\x02{p}\x03" if h or p else "" for h, p in zip(hosts, paths, strict=True)]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    within_path = np.cumsum(codes == 2) > np.cumsum(codes == 1) - 1  # from a path's mark to the end of its row
    rows, buckets = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        mixed = np.full(last, n, dtype=np.uint64)
        for k in range(n):
            mixed = (mixed ^ codes[k : k + last]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ within_path[:last].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        inside = row[:last] == row[n - 1 :]
        rows.append(row[:last][inside])
        buckets.append((mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    pair, count = np.unique(row << BITS | bucket, return_counts=True)
    row, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
    length = np.sqrt(np.bincount(row, count.astype(float) ** 2, minlength=len(marked)))
    return row, bucket, count / length[row]


@dataclass
class Model:
    """Weights of the buckets, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a URL is unwanted; the same for all that have neither host nor path."""
        row, bucket, share = grams(hosts, paths)
        sums = np.bincount(row, share * self.weights[bucket], minlength=len(hosts))
        return 1 / (1 + np.exp(-(self.bias + sums)))


def trained(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> Model:
    """A model of greatest penalised likelihood from a small table of labelled URLs.

    Repeated URLs with one label count once, null URLs or labels not at all. More than
    ``MOST_LABELLED`` URLs raise; one class or none gives a model that allows everything.
    The rows are solved for on the driver: weights are sums of the rows' n-grams, so there
    are as many unknowns as URLs.
    """
    host, path = parts(F.col(f"`{url}`"))
    rows = labelled.where(F.col(f"`{url}`").isNotNull() & F.col(f"`{blocked}`").isNotNull())
    rows = rows.select(host.alias("host"), path.alias("path"), F.col(f"`{blocked}`").cast("int").alias("blocked"))
    known = rows.distinct().orderBy("host", "path", "blocked").limit(MOST_LABELLED + 1).collect()
    if len(known) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    y = np.array([r.blocked for r in known], dtype=float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS), -10.0)
    row, bucket, share = grams([r.host for r in known], [r.path for r in known])
    columns, place = np.unique(bucket, return_inverse=True)
    x = np.zeros((len(known), len(columns)), dtype=np.float32)
    x[row, place] = share
    kernel = (x @ x.T).astype(float) + 1.0  # the bias is a feature that every row has
    alpha = np.zeros(len(known))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-kernel @ alpha))
        bend = np.maximum(p * (1 - p), 1e-6)
        target = kernel @ alpha + (y - p) / bend
        step = np.linalg.solve(kernel + np.diag(PENALTY / bend), target)
        if np.abs(step - alpha).max() < 1e-8:
            break
        alpha = step
    weights = np.zeros(1 << BITS)
    weights[columns] = x.T @ alpha
    return Model(weights, float(alpha.sum()))


def judged(
    pages: DataFrame, allow: list[Rule], block: list[Rule], model: Model, cutoff: float = 0.5,
    page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score): one per input row, in one pass without a shuffle.

    ``verdict`` is that of the longest fitting rule; without one, block if the model's
    score exceeds ``cutoff``. A rule on both lists raises. A URL that is null or has no
    ``://`` has empty host and path, no rule, and the score of the model's bias. Null and repeated ids and repeated URLs are
    rows like others; other columns are not read; an empty table gives no rows.
    """
    if both := set(allow) & set(block):
        raise ValueError(f"rules that allow and block: {sorted(both)}")
    host, path = parts(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    scored = rows.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    ruled = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block]))
    blocking = F.col("rule").isin([h + p for h, p in block])
    verdict = F.when(F.coalesce(blocking, F.col("score") > cutoff), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
