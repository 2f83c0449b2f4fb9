"""Review-shaped tables derived from the driver tables, in Spark and as SQL text for the check.

Every table covers all rows of its driver table and carries whole texts. Nothing here is part of the library.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill import schemas, vocab
from reviewmill.operators import anomaly, listing, product_features
from reviewmill.session import new_path, settle

PHRASES = [
    "The battery died and the charger is loose! ",
    "Bluetooth keeps disconnecting, is it defective? ",
    "Arrived damaged with missing parts, want a refund. ",
    "Screen cracked after 2 weeks, waste of money. ",
    "Too small, does not fit; wrong size. ",
    "Not as described, misleading and flimsy. ",
    "USB port stopped working, returned it. ",
    "Great keyboard, éfan and portö work perfectly. ",
    "Overpriced, rip off, terrible speaker noise. ",
    "Fan is noisy and keeps overheating. ",
]
TITLES = {"error": "Broken battery", "signup": "Slow and laggy", "view": "Okay", "click": "Good screen"}
RATINGS = {"error": 1.0, "signup": 2.0, "view": 3.0, "click": 4.0}
LABEL_ANSWERS = [
    'Sure: {"defect": 1, "shipping": 0, "description": 1, "size": 0, "price": 0} done',
    '{"defect": true, "size": 1.0}',
    "no json here",
    '{"defect": "1", "price": 2}',
    '{"shipping": 1',
    '{"price": 1}',
]
JUDGE_ANSWERS = [
    '{"accuracy": 5, "completeness": 4, "actionability": 3, "conciseness": 2}',
    'Scores: {"accuracy": 0, "completeness": 9, "actionability": 2.5, "conciseness": 1}',
    '{"accuracy": "4", "completeness": "2.5", "actionability": 3, "conciseness": 5}',
    '{"accuracy": 2}',
    '{"accuracy": null, "completeness": 4}',
    "I cannot score this.",
    '{"accuracy": "high", "completeness": 4}',
]
REWRITE_ANSWERS = [
    '{"title": "Honest title", "description": "Honest text", "changes": ["title", "claims"]}',
    ' Plain rewritten text. ',
    '{"description": "Only text"}',
    '{"title": Broken}',
]

TASK_ROWS = 200_000  # reviews of a task
_settled: dict[tuple[str, str, str], DataFrame] = {}


def cycle(key: str, values: list[str]):
    """The value at position key mod len(values)."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


class Tables:
    """The driver tables of one folder and what is derived from them. Features and entities are written once; reviews are not, as
    joining a text to an event again costs less than writing and reading it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return new_path(self.spark, name)

    def _settled(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _settled:
            _settled[key] = settle(build(), name)
        return _settled[key]

    def review_rows(self, events: DataFrame, tasks: int | None = None, *others: str) -> DataFrame:
        """Reviews from event rows (a stream or a table), each with the whole text of one document, and ``others`` of the events.

        With ``tasks``, both sides are laid out by document over that many tasks. The sides are narrow compared with
        the joined rows, so sizes measured before the join would choose too few.
        """
        documents = self.source("documents").select("doc_id", F.col("text").alias("doc_text"), "source")
        events = events.withColumn("doc_id", F.col("event_id") % documents.count())
        if tasks:
            events, documents = events.repartition(tasks, "doc_id"), documents.repartition(tasks, "doc_id")
        joined = events.join(documents, "doc_id")
        event, user = F.col("event_id"), F.col("user_id")
        phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (event % (2 + user % 9) + 1).cast("int"))
        title = rating = None
        for kind in TITLES:
            hit = F.col("event_type") == kind
            title = F.when(hit, TITLES[kind]) if title is None else title.when(hit, TITLES[kind])
            rating = F.when(hit, RATINGS[kind]) if rating is None else rating.when(hit, RATINGS[kind])
        title, rating = title.otherwise("Great"), rating.otherwise(5.0)
        parent = F.concat(F.lit("P"), (user * 20).cast("string"))
        return joined.select(
            event.alias("id"),
            F.when(event % 103 != 0, F.when(user % 2 == 0, parent).otherwise(F.concat(F.lit("A"), user.cast("string"))))
            .alias("asin"),
            parent.alias("parent_asin"),
            F.concat(F.lit("U"), (event % 500).cast("string")).alias("user_id"),
            F.when(event % 97 != 0, rating).alias("rating"),
            F.when(event % 83 != 0, F.concat(title, F.lit(" ("), F.col("source"), F.lit(")"))).alias("title"),
            F.when(event % 89 != 0, F.concat(phrase, F.col("doc_text"))).alias("text"),
            F.floor("value").cast("int").alias("helpful_votes"),
            F.when(event % 101 != 0, F.col("ts").cast("timestamp")).alias("timestamp"),
            *others,
        )

    @cached_property
    def reviews(self) -> DataFrame:
        events = self.source("events")
        tasks = max(self.spark.sparkContext.defaultParallelism, events.rdd.getNumPartitions(), -(-events.count() // TASK_ROWS))
        return self.review_rows(events, tasks)

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.source("part").select(
            F.concat(F.lit("P"), key.cast("string")).alias("parent_asin"),
            F.col("p_name").alias("title"),
            F.concat(F.lit("A "), F.col("p_name"), F.lit(" with long battery life and bluetooth.")).alias("description"),
            F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
            F.col("p_type").alias("category"),
            F.when(key % 3 == 0, "usb port; charger included").when(key % 3 == 1, "bright screen; fast").alias("features"),
            (F.col("p_size").cast("double") / 10).alias("average_rating"),
            F.col("p_size").alias("rating_number"),
        )

    def raw_reviews(self) -> DataFrame:
        """As downloaded: ``helpful_vote``, and epoch milliseconds as text with some unreadable values."""
        unreadable = F.when(F.col("id") % 2 == 0, "99999999999999999").when(F.col("id") % 3 == 0, str(2**63 - 1)).otherwise("unknown")
        millis = F.coalesce(F.unix_millis("timestamp").cast("string"), unreadable)
        raw = self.reviews.withColumnRenamed("helpful_votes", "helpful_vote").withColumn("timestamp", millis)
        return schemas.conform(raw, schemas.RAW_REVIEW)

    def raw_products(self) -> DataFrame:
        """As downloaded: list columns, a nested column, and an older row for every product."""
        rows = self.products.withColumn("old", F.explode(F.array(F.lit(0), F.lit(1))))
        return rows.select(
            "parent_asin",
            F.when(F.col("old") == 1, F.concat("title", F.lit(" (old)"))).otherwise(F.col("title")).alias("title"),
            F.array("title", "description").alias("description"),
            "price",
            F.col("category").alias("main_category"),
            F.split("features", "; ").alias("features"),
            "average_rating",
            (F.col("rating_number") - F.col("old")).alias("rating_number"),
            F.array(F.struct(F.lit("large").alias("size"), F.col("parent_asin").alias("url"))).alias("images"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """The stored feature table with entity maps."""
        return self._settled("features", lambda: product_features.product_features(self.reviews))

    @cached_property
    def entities(self) -> DataFrame:
        """The stored entity counts per product."""
        return self._settled("entities", lambda: listing.product_entities(self.reviews))

    @cached_property
    def scores(self) -> DataFrame:
        return self._settled("scores", lambda: anomaly.mean_square_scores(self.features))

    @cached_property
    def alerts(self) -> DataFrame:
        flagged = anomaly.flag(self.scores, anomaly.threshold(self.scores))
        return anomaly.alerts(flagged, F.col("date").cast("timestamp"))

    @cached_property
    def labelled(self) -> DataFrame:
        text = F.col("text")

        def flag(*phrases: str):
            hit = F.lit(False)
            for phrase in phrases:
                hit = hit | text.contains(phrase)
            return hit.cast("int")

        return self.reviews.filter("rating <= 2 AND text IS NOT NULL AND length(text) > 50").select(
            "id", "asin", "rating", "title", "text",
            flag("died", "cracked", "stopped working", "overheating", "defective").alias("defect"),
            flag("Arrived damaged").alias("shipping"),
            flag("Not as described").alias("description"),
            flag("wrong size").alias("size"),
            flag("waste of money", "Overpriced").alias("price"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        pairs = ", ".join(f"'{c}', {c}" for c in vocab.LABELS)
        long = self.labelled.selectExpr("id", f"stack({len(vocab.LABELS)}, {pairs}) AS (label, y)")
        percent = (F.col("id") * 37 + F.length("label") * 11) % 60 + 40 * F.col("y")
        return long.withColumn("prob_pct", percent.cast("int"))

    @cached_property
    def evaluations(self) -> DataFrame:
        """Every part judged for model "base"; model "tuned_v1" lacks the large ones."""
        rows = self.source("part").select(
            "p_partkey", "p_size", F.explode(F.array(F.lit("base"), F.lit("tuned_v1"))).alias("model_name")
        )
        key, size, n = F.col("p_partkey"), F.col("p_size"), F.length("model_name")
        scored = rows.filter("model_name = 'base' OR p_size <= 30").select(
            F.concat(F.lit("P"), key.cast("string")).alias("asin"),
            "model_name",
            (1 + (key * 7 + size + n) % 5).cast("double").alias("accuracy"),
            (1 + (key * 3 + n) % 5).cast("double").alias("completeness"),
            (2 + (size + n) % 4).cast("double").alias("actionability"),
            (3 + (key + n) % 3).cast("double").alias("conciseness"),
        )
        total = F.col("accuracy") + F.col("completeness") + F.col("actionability") + F.col("conciseness")
        return scored.withColumn("overall_score", total / 4).withColumn(
            "summary", F.concat(F.lit("Summary of "), F.col("asin"))
        )

    @cached_property
    def label_responses(self) -> DataFrame:
        return self.reviews.select("id", cycle("id", LABEL_ANSWERS).alias("content"))

    @cached_property
    def judge_responses(self) -> DataFrame:
        return self.reviews.select("id", cycle("id", JUDGE_ANSWERS).alias("content"))

    @cached_property
    def rewrite_responses(self) -> DataFrame:
        """One answer per asin, by the length of its name and its last digit."""
        asins = self.reviews.filter("asin IS NOT NULL").select("asin").distinct()
        keyed = asins.withColumn("k", F.substring("asin", -1, 1).cast("int") + F.length("asin"))
        return keyed.select(F.col("asin").alias("id"), cycle("k", REWRITE_ANSWERS).alias("content"))

    @cached_property
    def summary_responses(self) -> DataFrame:
        """A summary per asin; those whose name ends in 1 got an empty answer."""
        asins = self.reviews.filter("asin IS NOT NULL").select("asin").distinct()
        content = F.when(F.col("asin").endswith("1"), " ").otherwise(F.concat(F.lit(" Issues of "), F.col("asin")))
        return asins.select(F.col("asin").alias("id"), content.alias("content"))

    @cached_property
    def done_labels(self) -> DataFrame:
        return self.source("labels").select(F.col("doc_id").alias("id"))

    @cached_property
    def vectors(self) -> DataFrame:
        """Events meet embeddings before texts, which would be shuffled for all reviews otherwise."""
        embeddings = self.source("embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vec"))
        found = self.review_rows(self.source("events").join(embeddings, "event_id"), None, "vec")
        return found.select("id", "vec", "asin", "rating", "title", "text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def flat_pattern(phrases: list[str]) -> str:
    """The dictionary as a plain alternation, longest first: an independent form of the library's pattern."""
    ordered = sorted(phrases, key=lambda p: (-len(p), p))
    return quoted(r"\b(" + "|".join(ordered) + r")\b")


def _choose(key: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} {whens} ELSE {quoted(values[-1])} END"


def bounded(text: str) -> str:
    """Lower case with other letters than ASCII ones as "q": the check's word boundaries know ASCII letters only."""
    return f"regexp_replace(lower(coalesce({text}, '')), '[^\\x00-\\x7F\\P{{L}}]', 'q', 'g')"


def extract(text: str, phrases: list[str]) -> str:
    return f"list_distinct(regexp_extract_all({bounded(text)}, {flat_pattern(phrases)}, 1))"


def present(text: str, phrases: list[str]) -> str:
    return "(" + " + ".join(
        f"CAST(contains(lower(coalesce({text}, '')), {quoted(p)}) AS INTEGER)" for p in phrases
    ) + ")"


_ANSWERED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATINGS.items())
_TITLED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items())
_TITLE_TEXT = "concat_ws(' ', title, text)"

# Views in dependency order. A check query gets those it names, directly or through another view.
VIEWS = {
    "reviews": f"""
SELECT e.event_id AS id,
 CASE WHEN e.event_id % 103 = 0 THEN NULL WHEN e.user_id % 2 = 0 THEN 'P' || (e.user_id * 20) ELSE 'A' || e.user_id END AS asin,
 'P' || (e.user_id * 20) AS parent_asin, 'U' || (e.event_id % 500) AS user_id,
 CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE CAST(CASE e.event_type {_ANSWERED} ELSE 5.0 END AS DOUBLE) END AS rating,
 CASE WHEN e.event_id % 83 = 0 THEN NULL
  ELSE CASE e.event_type {_TITLED} ELSE 'Great' END || ' (' || d.source || ')' END AS title,
 CASE WHEN e.event_id % 89 = 0 THEN NULL
  ELSE {_choose("e.event_id % (2 + e.user_id % 9)", PHRASES)} || d.text END AS text,
 CAST(floor(e.value) AS INTEGER) AS helpful_votes,
 CASE WHEN e.event_id % 101 = 0 THEN NULL ELSE e.ts END AS timestamp
FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS doc_key FROM events) e JOIN documents d ON d.doc_id = e.doc_key""",
    "products": """
SELECT 'P' || p_partkey AS parent_asin, p_name AS title, 'A ' || p_name || ' with long battery life and bluetooth.' AS description,
 CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, p_type AS category,
 CASE p_partkey % 3 WHEN 0 THEN 'usb port; charger included' WHEN 1 THEN 'bright screen; fast' END AS features,
 CAST(p_size AS DOUBLE) / 10 AS average_rating, p_size AS rating_number FROM part""",
    "daily": f"""
SELECT asin, CAST(timestamp AS DATE) AS date, avg(rating) AS rating_avg, count(rating) AS review_count,
 count(*) FILTER (WHERE rating <= 2) AS negative_count, CAST(sum({present("text", vocab.COMPLAINT_KEYWORDS)}) AS BIGINT) AS complaint_keywords
FROM reviews WHERE asin IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2""",
    "features": """
SELECT asin, date, avg(rating_avg) OVER w AS daily_sentiment_avg, avg(review_count) OVER w AS review_velocity,
 negative_count / nullif(review_count, 0) AS negative_ratio, complaint_keywords
FROM daily WINDOW w AS (PARTITION BY asin ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "scored": """
SELECT f.asin, f.date, (coalesce(power((daily_sentiment_avg - m1) / s1, 2), 0) + coalesce(power((review_velocity - m2) / s2, 2), 0)
 + coalesce(power((negative_ratio - m3) / s3, 2), 0) + coalesce(power((complaint_keywords - m4) / s4, 2), 0)) / 4 AS anomaly_score
FROM features f, (SELECT avg(daily_sentiment_avg) m1, stddev_pop(daily_sentiment_avg) s1, avg(review_velocity) m2,
 stddev_pop(review_velocity) s2, avg(negative_ratio) m3, stddev_pop(negative_ratio) s3, avg(complaint_keywords) m4,
 stddev_pop(complaint_keywords) s4 FROM features) s""",
    "flagged": """
SELECT asin, date, anomaly_score, threshold, anomaly_score > threshold AS is_anomaly
FROM scored, (SELECT quantile_cont(anomaly_score, 0.95) AS threshold FROM scored) t""",
    "alerts": """
SELECT asin AS product_id, 'quality_anomaly' AS alert_type,
 CASE WHEN anomaly_score > threshold * 2 THEN 'critical' ELSE 'warning' END AS severity,
 CAST(date AS TIMESTAMP) AS detected_at,
 '{"anomaly_score":' || CAST(anomaly_score AS DECIMAL(18,6)) || ',"threshold":' || CAST(threshold AS DECIMAL(18,6))
 || ',"date":"' || date || '"}' AS details FROM flagged WHERE is_anomaly""",
    "labelled": """
SELECT id, asin, rating, title, text,
 CASE WHEN text LIKE '%died%' OR text LIKE '%cracked%' OR text LIKE '%stopped working%' OR text LIKE '%overheating%' OR text LIKE '%defective%' THEN 1 ELSE 0 END AS defect,
 CASE WHEN text LIKE '%Arrived damaged%' THEN 1 ELSE 0 END AS shipping,
 CASE WHEN text LIKE '%Not as described%' THEN 1 ELSE 0 END AS description,
 CASE WHEN text LIKE '%wrong size%' THEN 1 ELSE 0 END AS size,
 CASE WHEN text LIKE '%waste of money%' OR text LIKE '%Overpriced%' THEN 1 ELSE 0 END AS price
FROM reviews WHERE rating <= 2 AND text IS NOT NULL AND length(text) > 50""",
    "long_labels": "\nUNION ALL ".join(f"SELECT id, '{c}' AS label, {c} AS y FROM labelled" for c in vocab.LABELS),
    "predictions": """
SELECT id, label, y, CAST((id * 37 + length(label) * 11) % 60 + 40 * y AS INTEGER) AS prob_pct FROM long_labels""",
    "evaluations": """
SELECT *, (accuracy + completeness + actionability + conciseness) / 4 AS overall_score, 'Summary of ' || asin AS summary FROM (
SELECT 'P' || p_partkey AS asin, m AS model_name, CAST(1 + (p_partkey * 7 + p_size + length(m)) % 5 AS DOUBLE) AS accuracy,
 CAST(1 + (p_partkey * 3 + length(m)) % 5 AS DOUBLE) AS completeness, CAST(2 + (p_size + length(m)) % 4 AS DOUBLE) AS actionability,
 CAST(3 + (p_partkey + length(m)) % 3 AS DOUBLE) AS conciseness
FROM (SELECT *, unnest(['base', 'tuned_v1']) AS m FROM part) p WHERE m = 'base' OR p_size <= 30) x""",
    "label_responses": f"SELECT id, {_choose(f'id % {len(LABEL_ANSWERS)}', LABEL_ANSWERS)} AS content FROM reviews",
    "judge_responses": f"SELECT id, {_choose(f'id % {len(JUDGE_ANSWERS)}', JUDGE_ANSWERS)} AS content FROM reviews",
    "asins": "SELECT DISTINCT asin FROM reviews WHERE asin IS NOT NULL",
    "rewrite_responses": f"""
SELECT asin AS id, {_choose(f"(CAST(right(asin, 1) AS INTEGER) + length(asin)) % {len(REWRITE_ANSWERS)}", REWRITE_ANSWERS)} AS content FROM asins""",
    "summary_responses": "SELECT asin AS id, CASE WHEN asin LIKE '%1' THEN ' ' ELSE ' Issues of ' || asin END AS content FROM asins",
    "vectors": """
SELECT e.vec_id AS id, r.asin, r.rating, r.title, r.text, e.embedding AS vec FROM embeddings e JOIN reviews r ON r.id = e.vec_id""",
    "text_mentions": f"""
SELECT id, asin, CAST(timestamp AS DATE) AS date, 'component' AS kind, unnest({extract("text", vocab.COMPONENTS)}) AS entity FROM reviews
UNION ALL SELECT id, asin, CAST(timestamp AS DATE), 'issue', unnest({extract("text", vocab.ISSUES)}) FROM reviews""",
    "mentions": f"""
SELECT id, asin, 'component' AS kind, unnest({extract(_TITLE_TEXT, vocab.COMPONENTS)}) AS entity FROM reviews WHERE asin IS NOT NULL
UNION ALL SELECT id, asin, 'issue', unnest({extract(_TITLE_TEXT, vocab.ISSUES)}) FROM reviews WHERE asin IS NOT NULL""",
    "top_entities": """
SELECT asin, kind, entity, mentions, position FROM (
 SELECT *, row_number() OVER (PARTITION BY asin, kind ORDER BY mentions DESC, entity) AS position FROM (
  SELECT asin, kind, entity, count(*) AS mentions FROM mentions GROUP BY ALL) a) b WHERE position <= 10""",
    "profiles": """
SELECT r.asin, r.parent_asin, r.review_count, CAST(printf('%.2f', r.mean_rating) AS DOUBLE) AS avg_rating,
 CAST(printf('%.1f', r.share) AS DOUBLE) AS negative_pct,
 'Product has ' || r.review_count || ' reviews (avg ' || printf('%.2f', r.mean_rating) || ' stars, ' || printf('%.1f', r.share) || '% negative).' || chr(10)
 || coalesce((SELECT 'Top components:' || chr(10) || string_agg('  - ' || entity || ' (' || mentions || ' mentions)' || chr(10), '' ORDER BY position)
  FROM top_entities t WHERE t.asin = r.asin AND kind = 'component' AND position <= 5), '')
 || coalesce((SELECT 'Top issues:' || chr(10) || string_agg('  - ' || entity || ' (' || mentions || ' mentions)' || chr(10), '' ORDER BY position)
  FROM top_entities t WHERE t.asin = r.asin AND kind = 'issue' AND position <= 5), '') AS summary
FROM (SELECT asin, min(parent_asin) AS parent_asin, count(*) AS review_count, coalesce(avg(rating), 0) AS mean_rating,
 count(*) FILTER (WHERE rating <= 2) * 100 / count(*) AS share FROM reviews WHERE asin IS NOT NULL GROUP BY asin) r""",
    "listings": """
SELECT p.asin, coalesce(a.title, b.title, '') AS product_title,
 CASE WHEN a.parent_asin IS NOT NULL THEN coalesce(a.description, '') ELSE coalesce(b.description, '') END AS product_description,
 CASE WHEN a.parent_asin IS NOT NULL THEN coalesce(a.features, '') ELSE coalesce(b.features, '') END AS product_features,
 CASE WHEN a.parent_asin IS NOT NULL THEN coalesce(a.price, '') ELSE coalesce(b.price, '') END AS product_price,
 a.parent_asin IS NOT NULL OR b.parent_asin IS NOT NULL AS has_product
FROM (SELECT asin, min(parent_asin) AS parent_asin FROM reviews WHERE asin IS NOT NULL GROUP BY asin) p
LEFT JOIN products a ON a.parent_asin = p.asin LEFT JOIN products b ON b.parent_asin = p.parent_asin""",
    "mismatches": """
SELECT t.asin, 0 AS block, t.position, 'Listing mentions ''' || entity || '''' AS claim,
 mentions || ' reviews mention ''' || entity || ''' in complaints' AS complaint,
 CASE WHEN mentions >= 20 THEN 'high' ELSE 'medium' END AS severity
FROM top_entities t JOIN listings l ON l.asin = t.asin
WHERE kind = 'component' AND mentions >= 5
 AND contains(lower(l.product_title || ' ' || l.product_description || ' ' || l.product_features), entity)
UNION ALL
SELECT asin, 1, position, 'Listing does not address', '''' || entity || ''' mentioned in ' || mentions || ' reviews',
 CASE WHEN mentions >= 30 THEN 'high' WHEN mentions >= 15 THEN 'medium' ELSE 'low' END
FROM top_entities WHERE kind = 'issue' AND mentions >= 10""",
    "audits": """
SELECT p.*, l.product_title, l.product_description, l.product_features, l.product_price, m.high, m.medium, m.low,
 m.high + m.medium + m.low AS mismatch_count, m.packed AS mismatches,
 CASE WHEN m.high + m.medium + m.low > 0 THEN 'Found ' || (m.high + m.medium + m.low) || ' mismatches: ' || m.high || ' high, '
  || m.medium || ' medium, ' || m.low || ' low.' ELSE 'No significant mismatches found.' END AS audit_summary
FROM profiles p JOIN listings l ON l.asin = p.asin JOIN (
 SELECT a.asin, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'low') AS low,
  coalesce(string_agg('[' || severity || '] ' || claim || ': ' || complaint, '; ' ORDER BY block, position), '') AS packed
 FROM asins a LEFT JOIN mismatches m ON m.asin = a.asin GROUP BY a.asin) m ON m.asin = p.asin""",
    "decisions": """
SELECT *, CASE WHEN mismatch_count > 5 THEN 'needs_review' WHEN low = mismatch_count THEN 'approved' WHEN high > 0 THEN 'needs_review'
  ELSE 'approved' END AS final_status,
 CASE WHEN mismatch_count > 5 THEN 'Too many changes, needs human review' WHEN low = mismatch_count THEN 'All mismatches are low severity — auto-approved'
  WHEN high > 0 THEN 'High severity mismatch detected — requires human review' ELSE 'Changes look reasonable' END AS supervisor_notes
FROM audits""",
    "rewrites": """
SELECT a.asin,
 CASE WHEN j = '' OR NOT json_valid(j) THEN a.product_title ELSE coalesce(json_extract_string(j, '$.title'), a.product_title) END AS rewritten_title,
 CASE WHEN j = '' THEN trim(content) WHEN NOT json_valid(j) THEN a.product_description
  ELSE coalesce(json_extract_string(j, '$.description'), a.product_description) END AS rewritten_description,
 CASE WHEN j = '' THEN 'Full rewrite generated' WHEN NOT json_valid(j) THEN 'Rewrite failed: invalid JSON'
  ELSE coalesce(array_to_string(CAST(json_extract(j, '$.changes') AS VARCHAR[]), '; '), '') END AS changes_made
FROM (SELECT asin, product_title, product_description FROM listings) a
JOIN (SELECT *, regexp_extract(content, '(?s)(\\{.*\\})', 1) AS j FROM rewrite_responses) r ON r.id = a.asin""",
    "pair_inputs": """
SELECT c.asin, c.product_title, b.shown, 'Product: ' || coalesce(nullif(c.product_title, ''), 'Unknown') || chr(10) || chr(10)
 || 'Total reviews shown: ' || b.shown || chr(10) || chr(10) || 'Negative (1-2 stars): ' || b.negative || ' | Positive (4-5 stars): '
 || b.positive || chr(10) || chr(10) || '---' || chr(10) || chr(10) || b.lines AS input
FROM (SELECT r.asin, p.title AS product_title, count(*) AS review_count FROM reviews r LEFT JOIN products p ON p.parent_asin = r.parent_asin
 WHERE r.text IS NOT NULL AND length(r.text) > 30 AND r.asin IS NOT NULL GROUP BY ALL HAVING count(*) >= 20) c
JOIN (SELECT asin, count(*) AS shown, count(*) FILTER (WHERE rating <= 2) AS negative, count(*) FILTER (WHERE rating >= 4) AS positive,
 string_agg('[' || coalesce(CAST(rating AS INTEGER), 0) || ' stars] ' || coalesce(title, '') || chr(10) || substr(text, 1, 300) || chr(10), chr(10) ORDER BY position) AS lines
 FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY helpful_votes DESC NULLS LAST, id) AS position FROM reviews
  WHERE text IS NOT NULL AND asin IS NOT NULL) x WHERE position <= 50 GROUP BY asin) b ON b.asin = c.asin""",
}


def with_views(sql: str) -> str:
    """The check query with the views it needs as leading WITH clauses."""
    needed: set[str] = set()

    def visit(body: str) -> None:
        for name, text in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", body):
                needed.add(name)
                visit(text)

    visit(sql)
    if not needed:
        return sql
    # Materialised, so that filters on texts are not tested against pairs of rows inside the join.
    views = (f"{n} AS {'MATERIALIZED ' if n == 'reviews' else ''}({b})" for n, b in VIEWS.items() if n in needed)
    return "WITH " + ",\n".join(views) + "\n" + sql
