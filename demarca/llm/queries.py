"""The operators applied to whole driver tables, with production parameters, and their DuckDB twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demarca.llm import centroids, decontamination, line_runs, mixture, pieces, quality_rules, ranked_search, simhash
from demarca.llm import suffix_spans, token_counts, toxicity, training_order, url_filter
from demarca.llm.common import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; a quarter of the ids, by crc32, is held out of all learning."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2).alias("held_out")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fitted(docs, labels, ~held)
    found = toxicity.scored(docs, lexicon)
    return found.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "weight", "n_words")


@query
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride token records, each in its slot of the training order and written to its shard."""
    made = training_order.arranged(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), key=2026)
    return training_order.write_shards(made, shared_folder(spark))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, the base rule's verdict and the certified rules' verdict."""
    measured = stored(quality_rules.measured(table(spark, sf_dir, "documents")))
    chosen = stored(quality_rules.cutoffs(measured, table(spark, sf_dir, "labels")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_rules.judged(measured, chosen)
    return judged.select("doc_id", *[f"m.{n}" for n in names], "base_failed", "kept", "failed_rules")


def _op3_sql() -> str:
    limit, rules = quality_rules.Risk(), quality_rules.RULES
    grid = ", ".join(f"('{r}', {c})" for r, (_, _, cuts) in rules.items() for c in cuts)
    value = " ".join(f"WHEN '{r}' THEN 1000 * {a} > cutoff * {b}" for r, (a, b, _) in rules.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text
              FROM documents),
parts AS (
    SELECT k, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM docs),
spots AS (
    SELECT k, i, list_slice(w, i, i + 7) AS gram FROM parts, range(1, len(w) - 6) t(i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM spots) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT i + d) AS n FROM twice, range(8) t(d) GROUP BY k),
m AS (
    SELECT k, doc_id, lang, len(w) AS n_words,
           length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           len(lines) AS n_lines, length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_capitals
    FROM parts LEFT JOIN covered USING (k)),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1 HAVING min(quality) IS NOT NULL),
grid(rule, cutoff) AS (VALUES {grid}),
tests AS (
    SELECT lang, rule, cutoff, count(*) FILTER (quality = 1) AS good,
           count(*) FILTER (quality = 1 AND hit) AS lost, count(*) FILTER (quality = 0 AND hit) AS caught
    FROM (SELECT *, CASE rule {value} END AS hit FROM m JOIN marks USING (doc_id), grid)
    GROUP BY ALL HAVING count(*) FILTER (quality = 1) > 0),
strata AS (SELECT count(DISTINCT lang) AS n FROM tests),
tails AS (
    SELECT lang, rule, cutoff, caught - {limit.price} * lost AS gain,
           (SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({limit.risk})
                           + (good - i) * ln(1 - {limit.risk}))) FROM range(0, lost + 1) t(i)) AS tail
    FROM tests WHERE lost < good * {limit.risk}),
chosen AS (
    SELECT lang, rule, arg_max(cutoff, gain * 10000 + cutoff) AS cutoff FROM tails, strata
    WHERE tail <= {limit.level} / (strata.n * {len(rules)}) AND gain > 0 GROUP BY ALL),
failed AS (
    SELECT k, string_agg(rule, ',' ORDER BY list_position({list(rules)}, rule)) AS failed_rules
    FROM m JOIN chosen USING (lang) WHERE CASE rule {value} END GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed_rules IS NULL AS kept,
       coalesce(failed_rules, '') AS failed_rules
FROM m LEFT JOIN failed USING (k)
"""


ORACLE["op3_quality_rules"] = _op3_sql()


@query
def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated line runs, as digests."""
    kept = line_runs.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Every pair of equal lines lies on a diagonal of two documents; its islands are the repeated runs.
ORACLE["op4_line_runs"] = f"""
WITH l AS (
    SELECT doc_id, i AS pos, p[i] AS line, len(regexp_extract_all(p[i], '[^\\x20\\x09-\\x0D]+')) AS n_words
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), range(1, len(p) + 1) t(i)),
pairs AS (
    SELECT a.doc_id, a.pos, b.doc_id AS other, a.pos - b.pos AS shift, a.n_words
    FROM l a JOIN l b ON a.line = b.line AND (b.doc_id, b.pos) < (a.doc_id, a.pos)),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY pos) AS island FROM pairs),
gone AS (
    SELECT DISTINCT doc_id, pos FROM (
        SELECT doc_id, pos, sum(n_words) OVER (PARTITION BY doc_id, other, shift, island) AS total FROM islands)
    WHERE total >= {line_runs.LEAST_WORDS})
SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
"""


@query
def op5_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 400 bytes that occur twice, as digests."""
    kept = suffix_spans.dedup(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    coded = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


SHARDS = 8


@query
def op7_mixture_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, each with the corpus mixture of sources."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    mixed = mixture.interleave(docs, SHARDS, ties=["text_crc32", "size"])
    return mixed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "global_slot",
    )


#: The crc32 column folds the text's bytes over the table that the polynomial gives.
ORACLE["op7_mixture_shards"] = f"""
WITH bits AS (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS v FROM bits),
docs AS (
    SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
           md5(concat('42:', coalesce(doc_id::VARCHAR, ''))) AS mixed
    FROM documents),
sums AS (
    SELECT doc_id, source, size, mixed,
           xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(size - 1),
                            lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
               lambda c, b: xor(crc.v[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
    FROM docs, crc),
placed AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY mixed, doc_id) - 1)::DOUBLE
              / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS share
    FROM sums),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY share, mixed, source, doc_id) - 1 AS global_slot, count(*) OVER () AS n
    FROM placed),
cut AS (SELECT *, global_slot * {SHARDS} // n AS shard FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard,
       global_slot - (shard * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard, source, global_slot
FROM cut
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, by item."""
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long"), F.col("window").cast("long"))


#: All equal words of documents and items by alignment; the best window starts at one of them, or ends the item.
ORACLE["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
b AS (
    SELECT item_id, w, least(len(w), {decontamination.WINDOW}) AS size
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark)),
dw AS (SELECT doc_id, i AS spot, w[i] AS word FROM d, range(1, len(w) + 1) t(i)),
bw AS (SELECT item_id, i AS spot, w[i] AS word, size, len(w) AS n FROM b, range(1, len(w) + 1) t(i)),
same AS (
    SELECT doc_id, item_id, dw.spot - bw.spot AS shift, bw.spot AS spot, size, n FROM dw JOIN bw USING (word)),
many AS (
    SELECT doc_id, item_id, shift, list(spot) AS spots, any_value(size) AS size, any_value(n) AS n
    FROM same GROUP BY doc_id, item_id, shift HAVING count(*) >= 0.8 * any_value(size)),
best AS (
    SELECT doc_id, item_id, size,
           list_max(list_transform(spots, lambda s: len(list_filter(spots, lambda x:
               x >= least(s, n - size + 1) AND x < least(s, n - size + 1) + size)))) AS matched
    FROM many)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, size::BIGINT AS "window"
FROM best WHERE matched >= ceil(0.8 * size) GROUP BY ALL
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE token counts of all documents."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op10_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of all documents."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


CLUSTERS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in sixteen clusters after three rounds."""
    found = centroids.clustered(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, DIMS, SCALE)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of_cluster = [x if x < 1 << 63 else None for x in found.inertias]
    total = sum(found.inertias)
    clusters = spark.createDataFrame(
        list(zip(range(len(digests)), of_cluster, digests, strict=True)),
        "cluster int, cluster_inertia long, centroid_sha256 string",
    )
    rows = found.rows.join(F.broadcast(clusters), "cluster")  # one row per centroid
    inertia = F.lit(total if total < 1 << 63 else None).cast("long").alias("inertia")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")


def _op11_sql() -> str:
    steps = f"""
WITH v AS (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}),
e AS (SELECT k, i AS j, x[i] AS x FROM v, range(1, {DIMS + 1}) t(i)),
c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x
    FROM v QUALIFY c < {CLUSTERS})"""
    for n in range(ROUNDS + 1):
        steps += f""",
p{n} AS (
    SELECT k, c, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i])))::BIGINT AS d
    FROM v, c{n} m),
a{n} AS (SELECT k, c, d FROM p{n} QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, c) = 1)"""
        if n < ROUNDS:
            steps += f""",
s{n} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN e USING (k) GROUP BY c, j),
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN m{n} m USING (c))"""
    return f"""{steps}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} m USING (c) JOIN v USING (k)
"""


ORACLE["op11_centroid_clusters"] = _op11_sql()

ALLOWED = [("org", "/"), ("com", "/fr/")]
BLOCKED = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]


@query
def op12_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by rules, then by a model trained from the default labelled URLs."""
    model = url_filter.trained(spark.createDataFrame(url_filter.sample_urls(), "url string, blocked int"))
    return url_filter.judged(table(spark, sf_dir, "pages"), ALLOWED, BLOCKED, model)


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op13_sql() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    words = words.format("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM d),
t AS (SELECT k, word, count(*) AS tf FROM (SELECT k, unnest(w) AS word FROM d) GROUP BY ALL),
b AS (SELECT DISTINCT item_id, unnest({words}) AS word FROM benchmark),
f AS (
    SELECT word, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
    FROM t, c GROUP BY word, docs),
s AS (
    SELECT item_id, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + 50 * len(w) * docs // total))))::BIGINT AS score
    FROM b JOIN f USING (word) JOIN t USING (word) JOIN d USING (k), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s JOIN d USING (k) WHERE score > 0 QUALIFY rank <= 50
"""


ORACLE["op13_ranked_search"] = _op13_sql()
