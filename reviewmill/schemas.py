"""Declared table schemas and tolerant projection onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "timestamp": T.TimestampType(), "date": T.DateType(), "array<string>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike ``fromDDL`` it needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


RAW_REVIEW = struct(
    "asin string, parent_asin string, user_id string, rating double, title string, text string, "
    "helpful_vote int, timestamp string"
)
REVIEW = struct(
    "asin string, parent_asin string, user_id string, rating double, title string, text string, "
    "helpful_votes int, timestamp timestamp"
)
REVIEW_WITH_ID = T.StructType([T.StructField("id", T.LongType()), *REVIEW.fields])
RAW_PRODUCT = struct(
    "parent_asin string, title string, description array<string>, price string, main_category string, "
    "features array<string>, average_rating double, rating_number int"
)
PRODUCT = struct(
    "parent_asin string, title string, description string, price string, category string, features string, "
    "average_rating double, rating_number int"
)
PRODUCT_FEATURES = struct(
    "asin string, date date, daily_sentiment_avg double, review_velocity double, negative_ratio double, "
    "complaint_keywords bigint, ner_entities string"
)
ALERT = struct(
    "product_id string, alert_type string, severity string, detected_at timestamp, details string"
)
TRACKER = struct("product_id string, status string, last_analyzed timestamp, summary string")
EVALUATION = struct(
    "asin string, model_name string, accuracy double, completeness double, actionability double, "
    "conciseness double, overall_score double, summary string"
)
LABELLED_REVIEW = struct(
    "id bigint, asin string, rating double, title string, text string, "
    "defect int, shipping int, description int, size int, price int"
)
PAIR = struct("asin string, product_title string, input string, summary string")

TABLES = {
    "reviews": REVIEW_WITH_ID,
    "products": PRODUCT,
    "product_features": PRODUCT_FEATURES,
    "alerts": ALERT,
    "application_tracker": TRACKER,
    "evaluations": EVALUATION,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema``: present columns are cast, absent ones become typed nulls, others are dropped."""
    present = set(df.columns)
    return df.select(
        *(
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )
