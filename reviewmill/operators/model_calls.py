"""Tables around language-model calls: requests, a batch client hook, and response parsing.

No client is shipped. Requests have columns (id, system, user); responses have (id, content).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill import vocab
from reviewmill.functions import jsontext as js
from reviewmill.functions import text as tx
from reviewmill.operators import aggregates, joins, ranking

LABEL_SYSTEM = (
    "Classify the root causes of a negative product review. Answer with one JSON object whose keys are "
    + ", ".join(vocab.LABELS) + "; a key is 1 if the cause applies and 0 if not."
)
JUDGE_SYSTEM = (
    "Rate a summary of product reviews from 1 to 5. Answer with one JSON object whose keys are "
    + ", ".join(vocab.CRITERIA) + "."
)
SUMMARY_SYSTEM = (
    "Summarise the customer reviews of a product: overall sentiment with the share of negative reviews, the top "
    "three complaints with their counts, key insights, one recommendation. Use only numbers from the reviews."
)
REWRITE_SYSTEM = (
    "Rewrite a product listing so that it is honest about frequent complaints. Answer with one JSON object with "
    "the keys title, description and changes (a list)."
)

# The instruction format for fine-tuning. The frames of the other prompts below must match as output too.
TUNING_START = (
    "<s>[INST] You are an expert product analyst. Given the following customer reviews, write a structured executive "
    "summary.\n\n"
)
TUNING_MIDDLE, TUNING_END = "\n[/INST]\n", "</s>"

# Lengths of text prefixes that go into prompts.
LABEL_TEXT, JUDGE_INPUT, SUMMARY_INPUT, SHOWN_TEXT = 1000, 2000, 4000, 300
LISTING_DESCRIPTION, LISTING_FEATURES, STORED_SUMMARY = 500, 300, 500


def label_requests(reviews: DataFrame) -> DataFrame:
    return reviews.select("id", F.lit(LABEL_SYSTEM).alias("system"), tx.prefix(F.col("text"), LABEL_TEXT).alias("user"))


def parse_labels(responses: DataFrame) -> DataFrame:
    """Five 0/1 columns: 1 only where the JSON value equals one; missing or invalid JSON gives zeros."""
    parsed = responses.withColumn("_json", js.parse_embedded(F.col("content")))
    flags = [js.is_one(F.col("_json"), label).alias(label) for label in vocab.LABELS]
    return parsed.select(*(c for c in responses.columns if c != "content"), *flags)


def summary_inputs(reviews: DataFrame, titles: DataFrame, shown: int = 50) -> DataFrame:
    """One prompt text per (asin, product_title): a header and the ``shown`` most helpful reviews.

    Texts are cut before the top-n, so long reviews never travel; a product contributes at most ``shown`` rows.
    """
    narrow = reviews.filter(F.col("text").isNotNull()).select(
        "asin", "id", "helpful_votes", "rating", "title", tx.prefix(F.col("text"), SHOWN_TEXT).alias("text")
    )
    top = ranking.most_helpful(narrow, shown)
    line = F.concat(
        F.lit("["), F.coalesce(F.col("rating").cast("int"), F.lit(0)).cast("string"), F.lit(" stars] "),
        F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n"),
    )
    blocks = top.groupBy("asin").agg(
        F.count("*").alias("shown"),
        F.count_if(F.col("rating") <= 2).alias("negative"),
        F.count_if(F.col("rating") >= 4).alias("positive"),
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"),
    )
    head = F.concat(
        F.lit("Product: "), F.coalesce(F.nullif("product_title", F.lit("")), F.lit("Unknown")),
        F.lit("\n\nTotal reviews shown: "), F.col("shown").cast("string"),
        F.lit("\n\nNegative (1-2 stars): "), F.col("negative").cast("string"),
        F.lit(" | Positive (4-5 stars): "), F.col("positive").cast("string"), F.lit("\n\n---\n\n"),
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return blocks.join(titles.select("asin", "product_title"), "asin").select(
        "asin", "product_title", "shown", F.concat(head, body).alias("input")
    )


def pair_candidates(
    reviews: DataFrame, products: DataFrame, done: DataFrame, min_reviews: int = 20, target: int | None = None
) -> DataFrame:
    """Prompt inputs of products that still need a summary: enough reviews and not done.

    With ``target`` those with the most reviews only, chosen after the done ones are gone. Only the reviews of chosen
    products are ranked.
    """
    chosen = joins.not_done(aggregates.products_with_reviews(reviews, products, min_reviews), done, "asin")
    if target is not None:
        chosen = chosen.orderBy(F.desc("review_count"), "asin", "product_title").limit(target)
    theirs = reviews.join(chosen.select("asin"), "asin", "left_semi")
    inputs = summary_inputs(theirs, chosen)
    return inputs.filter(F.col("shown") >= min_reviews).select("asin", "product_title", "input")


def summary_requests(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        F.col("asin").alias("id"), F.lit(SUMMARY_SYSTEM).alias("system"),
        tx.prefix(F.col("input"), SUMMARY_INPUT).alias("user"),
    )


def training_pairs(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates with their non-empty summary; unanswered ones are left for a later run."""
    answered = responses.select(F.col("id").alias("asin"), F.trim("content").alias("summary")).filter("summary <> ''")
    return candidates.join(answered, "asin").select("asin", "product_title", "input", "summary")


def judge_requests(pairs: DataFrame) -> DataFrame:
    user = F.concat(
        F.lit("REVIEWS:\n"), tx.prefix(F.col("input"), JUDGE_INPUT), F.lit("\n\nSUMMARY TO EVALUATE:\n"), F.col("summary")
    )
    return pairs.select(F.col("asin").alias("id"), F.lit(JUDGE_SYSTEM).alias("system"), user.alias("user"))


def parse_judgements(responses: DataFrame) -> DataFrame:
    """Four criteria and their mean. A missing key is 3, values are kept within 1..5.

    Invalid JSON, or a value that is no number (null included), makes the whole row 3.
    """
    parsed = responses.withColumn("_json", js.parse_embedded(F.col("content")))
    values, valid = [], F.col("_json").isNotNull()
    for name in vocab.CRITERIA:
        missing = js.field(F.col("_json"), name).isNull()
        number = F.try_variant_get("_json", f"$.{name}", "double")
        values.append(F.when(missing, F.lit(3.0)).otherwise(tx.clip(number, 1.0, 5.0)).alias(f"v_{name}"))
        valid = valid & (missing | number.isNotNull())
    keys = [c for c in responses.columns if c != "content"]
    scored = parsed.select(*keys, valid.alias("_valid"), *values)
    final = [F.when(F.col("_valid"), F.col(f"v_{c}")).otherwise(F.lit(3.0)).alias(c) for c in vocab.CRITERIA]
    total = sum((F.col(c) for c in vocab.CRITERIA), F.lit(0.0)) / len(vocab.CRITERIA)
    return scored.select(*keys, *final).withColumn("overall_score", total)


def rewrite_requests(audited: DataFrame) -> DataFrame:
    """One request per product with mismatches."""
    complaints = F.array_join(
        F.transform("mismatches", lambda m: F.concat(F.lit("- ["), m["severity"], F.lit("] "), m["complaint"])), "\n"
    )
    issues = F.array_join(
        F.transform(
            F.slice("top_issues", 1, 5),
            lambda e: F.concat(e["entity"], F.lit(" ("), e["n"].cast("string"), F.lit("x)")),
        ),
        ", ",
    )
    user = F.concat(
        F.lit("Current Title: "), F.col("product_title"),
        F.lit("\nCurrent Description: "), tx.prefix(F.col("product_description"), LISTING_DESCRIPTION),
        F.lit("\nCurrent Features: "), tx.prefix(F.col("product_features"), LISTING_FEATURES),
        F.lit("\n\nCustomer Complaints:\n"), complaints,
        F.lit("\n\nTop Issues: "), issues,
        F.lit("\n\nRewrite the listing to address these issues."),
    )
    return audited.filter(F.size("mismatches") > 0).select(
        F.col("asin").alias("id"), F.lit(REWRITE_SYSTEM).alias("system"), user.alias("user")
    )


def parse_rewrites(originals: DataFrame, responses: DataFrame) -> DataFrame:
    """Rewritten title, description and changes per asin.

    Without JSON the whole answer is the description; with invalid JSON the originals stay.
    """
    rows = originals.select("asin", "product_title", "product_description").join(
        responses.select(F.col("id").alias("asin"), F.trim("content").alias("content")), "asin"
    )
    found = rows.withColumn("_object", js.embedded_object(F.col("content")))
    parsed = found.withColumn("_json", F.try_parse_json("_object"))
    plain, broken = F.col("_object").isNull(), F.col("_json").isNull()

    def text_field(name: str, fallback: Column) -> Column:
        return F.when(js.field(F.col("_json"), name).isNull(), fallback).otherwise(
            F.try_variant_get("_json", f"$.{name}", "string")
        )

    changes = F.coalesce(F.try_variant_get("_json", "$.changes", "array<string>"), F.array().cast("array<string>"))
    return parsed.select(
        "asin",
        F.when(plain | broken, F.col("product_title")).otherwise(text_field("title", F.col("product_title"))).alias("rewritten_title"),
        F.when(plain, F.col("content")).when(broken, F.col("product_description"))
        .otherwise(text_field("description", F.col("product_description"))).alias("rewritten_description"),
        F.when(plain, F.array(F.lit("Full rewrite generated")))
        .when(broken, F.array(F.lit("Rewrite failed: invalid JSON"))).otherwise(changes).alias("changes_made"),
    )


def tuning_texts(pairs: DataFrame) -> DataFrame:
    """Instruction text for fine-tuning: prompt with the input cut to 2000 characters, then the summary."""
    text = F.concat(
        F.lit(TUNING_START), tx.prefix(F.col("input"), JUDGE_INPUT), F.lit(TUNING_MIDDLE), F.col("summary"), F.lit(TUNING_END)
    )
    return pairs.select("asin", text.alias("text"))


def call_model(requests: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """Run a batch client over a request table; returns (id, content).

    ``make_client`` is called once per task and gives a function from a frame of requests to a series of answers. A
    failed task calls again, so answers should be written to a table and read with ``not_done`` on a rerun.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "content": client(batch)})

    schema = T.StructType([requests.schema["id"], T.StructField("content", T.StringType())])
    return requests.select("id", "system", "user").mapInPandas(answer, schema)


def stub_label_client() -> Callable[[pd.DataFrame], pd.Series]:
    """An offline stand-in: answers with the labels whose first rule phrase is in the text."""
    first = {label: phrases[0] for label, phrases in vocab.RULES_V1.items()}

    def client(batch: pd.DataFrame) -> pd.Series:
        lowered = batch["user"].str.lower()
        parts = [f'"{label}": ' + lowered.str.contains(p, regex=False).astype(int).astype(str) for label, p in first.items()]
        joined = parts[0]
        for part in parts[1:]:
            joined = joined + ", " + part
        return "Labels: {" + joined + "}"

    return client


def failing_label_client() -> Callable[[pd.DataFrame], pd.Series]:
    """The stand-in, but it gives up at its third batch, as a client does that has used up its quota."""
    inner, calls = stub_label_client(), []

    def client(batch: pd.DataFrame) -> pd.Series:
        calls.append(len(batch))
        if len(calls) > 2:
            raise RuntimeError("quota used up")
        return inner(batch)

    return client
