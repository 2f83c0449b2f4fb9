"""One query per operator over its whole table, with production parameters, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import (
    backoff, collocations, exact_dedup, fingerprints, folds, language, lexicon, licenses, near_dedup, packing, quality, resampling,
    vectors, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

BYTE_LEVEL, WORD_LEVEL = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
QUALITY_FOLDS, QUALITY_HELD_OUT, LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 3, 1, 5, 0


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if check:
            CHECKS[name] = check
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(count: int, number: int):
    return F.coalesce(folds.fold("doc_id", count) == number, F.lit(False)).alias("held_out")


@query("op1_warc_archives")
def _(spark, sf_dir):
    archives = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    found = warc.read_archives(archives)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


NEAR = """WITH RECURSIVE words AS MATERIALIZED (
 SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0) x),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b, p.n = x.n AND p.n = y.n AS same FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
 WHERE p.n / (x.n + y.n - p.n) >= 0.8),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n, min(b) FILTER (WHERE same) AS same FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, c.same) AS class_id, coalesce(c.n, 0) AS n_links, least(d.doc_id, l.b) AS component_id,
 least(d.doc_id, l.b) = d.doc_id AS kept FROM documents d LEFT JOIN counted c ON c.a = d.doc_id LEFT JOIN lowest l ON l.a = d.doc_id"""


@query("op2_ngram_jaccard_join", NEAR)
def _(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def best_fit_packing(docs: DataFrame) -> DataFrame:
    return packing.pack(packing.cut(docs, BYTE_LEVEL))


@query("op3_best_fit_packing")
def _(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"))


@query("op4_embedding_near_dedup")
def _(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


EXACT = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query("op5_exact_dedup", EXACT)
def _(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def quality_weights(spark: SparkSession, sf_dir: str):
    """Weights from the labelled rows outside the held-out fold."""
    learned = folds.fold("doc_id", QUALITY_FOLDS) != QUALITY_HELD_OUT
    return quality.train(table(spark, sf_dir, "documents").filter(learned), table(spark, sf_dir, "labels"))


@query("op6_quality_classifier")
def _(spark, sf_dir):
    scores = quality.score(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return scores.select("doc_id", held_out(QUALITY_FOLDS, QUALITY_HELD_OUT), "score", "predicted")


@query("op7_license_scan")
def _(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def language_trees(spark: SparkSession, sf_dir: str) -> language.ContextTrees:
    """Context trees from the rows outside the held-out fold."""
    learned = folds.fold("doc_id", LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT
    return language.learn(table(spark, sf_dir, "documents").filter(learned), "doc_id", "text", "lang")


@query("op8_language_id")
def _(spark, sf_dir):
    found = language.identify(table(spark, sf_dir, "documents"), language_trees(spark, sf_dir))
    return found.select("doc_id", held_out(LANGUAGE_FOLDS, LANGUAGE_HELD_OUT), "lang_pred", "score", "bits_per_byte")


@query("op9_bpe_lexicon")
def _(spark, sf_dir):
    return lexicon.encode_digests(table(spark, sf_dir, "documents"), WORD_LEVEL)


SCORES = """WITH words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^ \t\n\r\f\v]+') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS size, unnest(range(1, len(w) + 1)) AS i, w FROM words),
found AS (SELECT doc_id, size, i, w[i] AS a, CASE WHEN i > 1 THEN w[i-1:i] END AS b, CASE WHEN i > 2 THEN w[i-2:i] END AS c FROM places),
counted AS (SELECT *, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, doc_id) AS n1,
 count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY b, doc_id) AS n2,
 count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc_id) AS n3,
 greatest((SELECT count(*) FROM found) - size, 1) AS others FROM found),
contexts AS (SELECT *, lag(n1) OVER (PARTITION BY doc_id ORDER BY i) AS m1, lag(n2) OVER (PARTITION BY doc_id ORDER BY i) AS m2 FROM counted),
first AS (SELECT *, CASE WHEN n1 > 0 THEN ln(n1 / others) ELSE ln(0.4) - ln(others) END AS s1 FROM contexts),
second AS (SELECT *, CASE WHEN i = 1 THEN s1 WHEN n2 > 0 THEN ln(n2 / m1) ELSE ln(0.4) + s1 END AS s2 FROM first),
third AS (SELECT *, CASE WHEN i < 3 THEN s2 WHEN n3 > 0 THEN ln(n3 / m2) ELSE ln(0.4) + s2 END AS s3 FROM second),
sums AS (SELECT doc_id, sum(s3) AS total FROM third GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, round(coalesce(total, 0), 5) AS log_score, round(total / len(w.w), 5) AS mean_log_score
FROM words w LEFT JOIN sums USING (doc_id)"""


@query("op10_stupid_backoff", SCORES)
def _(spark, sf_dir):
    found = backoff.backoff_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", *(F.round(c, 5).alias(c) for c in ("log_score", "mean_log_score")))


RESAMPLED = """WITH polynomial AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
 list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
 FROM range(256) r(i)) x),
words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
target AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
features AS MATERIALIZED (SELECT doc_id, unnest(w) AS f FROM words UNION ALL
 SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
wanted AS (SELECT unnest(w) AS f FROM target UNION ALL
 SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM target),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM features UNION SELECT f FROM wanted) x),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::UBIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS b FROM bytes, polynomial),
s AS (SELECT b, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN hashed USING (f) GROUP BY b),
gains AS (SELECT b.b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM features) + 10000)) /
  ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000))))::BIGINT AS gain
 FROM range(10000) b(b) LEFT JOIN s ON s.b = b.b LEFT JOIN t ON t.b = b.b),
sums AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
 FROM features JOIN hashed USING (f) JOIN gains USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
 FROM words LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM scored WHERE able) * 25 // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""


@query("op11_importance_resampling", RESAMPLED)
def _(spark, sf_dir):
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


PHRASES = """WITH words AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
 SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents) x),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (
 SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS p FROM words, range(1, 6) x(m)) y
 GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, unnest([p[1 : len(p) - 1], p[2 :]]) AS p, f FROM counts WHERE len(p) > 2) x GROUP BY ALL),
kept AS (SELECT c.* FROM counts c LEFT JOIN inner_ i ON i.lang = c.lang AND i.p = c.p WHERE len(c.p) > 1 AND (i.f IS NULL OR 100 * i.f < 100 * c.f)),
cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM kept),
scored AS (SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.f AS a, k, x.f AS l, y.f AS r, n,
 ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts c
 JOIN counts x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1 :] JOIN size s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM lowest)
SELECT * FROM ranked WHERE rank <= 2000"""


@query("op12_phrase_collocations", PHRASES)
def _(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_document_fingerprints")
def _(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))
