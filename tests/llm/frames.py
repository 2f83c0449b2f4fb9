"""Small tables with everything that can go wrong in a row."""

from pyspark.sql import functions as F

LONG = "lorem ipsum " * 20_000 + "w" * 30_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog, again and again."),
    (7, "El niño está aquí. Ça va? Straße 12½ — ΟΔΟΣ <|endoftext|> 日本"),
    (8, "Released under the MIT License. Licensd under the Apache Lisense"),
    (9, "!!! ??? 123"),
    (None, "The quick brown fox jumps over the lazy dog, again and again."),
    (None, None),
    (None, "A text of its own without an id, and some more words."),
]
CLASHING = (
    "id key score lang lang_pred kept n_links block rows values size piece start length offset place slice label labels row"
    " text_sha256 keep low high set first n_words words data part archive url payload error component bucket band"
).split()


def with_clashes(df):
    """Columns that operators might use inside, all null or constant."""
    return df.withColumns({name: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, name in enumerate(CLASHING)})


def documents(spark, rows=TEXTS):
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def empty(spark):
    return with_clashes(spark.createDataFrame([], "doc_id long, text string"))


def by_id(df, key="doc_id"):
    """Rows as dictionaries, grouped by id."""
    found = {}
    for row in df.collect():
        found.setdefault(row[key], []).append(row.asDict())
    return found
