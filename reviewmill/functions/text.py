"""Text expressions: dictionary extraction, phrase scores, style features. All are native columns, unless told to ``scan``.

Native patterns cost several times the time of a byte that a scan of the bytes of many texts takes. Steps that read all texts and store
what they find ask for the scan, an Arrow UDF with the same results.
"""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import add, or_

import numpy as np
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import phrases as scans

# Unicode white space, written out so that Java and other engines split words alike.
LATIN_SPACE = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}"
SPACE = LATIN_SPACE + r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Word boundaries by Unicode letters and digits in every Java version (from 19 on they are ASCII without the flag).
UNICODE = "(?U)"
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _shared_prefixes(phrases: list[str]) -> str:
    """The phrases as one pattern that shares common prefixes and prefers longer phrases, e.g. ``bro(?:ken|ke)``."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for char in phrase:
            node = node.setdefault(char, {})
        node["end"] = {}

    def render(node: dict) -> str:
        branches = [re.escape(char) + render(child) for char, child in sorted(node.items()) if char != "end"]
        if len(branches) == 1 and "end" not in node:
            return branches[0]
        return f"(?:{'|'.join(branches)}){'?' if 'end' in node else ''}" if branches else ""

    return render(root)


def _first_letters(phrases: list[str]) -> str:
    return re.escape("".join(sorted({p[0] for p in phrases})))


def phrase_pattern(phrases: list[str]) -> str:
    """A whole-word pattern that finds the longest phrase at each spot.

    Phrases share their prefixes in the pattern and a look-ahead on first letters skips most words, so the cost per
    word hardly grows with the dictionary. Equal to trying the phrases one by one, longest first.
    """
    return rf"{UNICODE}\b(?=[{_first_letters(phrases)}])({_shared_prefixes(phrases)})\b"


def find_phrases(text: Column, phrases: list[str], scan: bool = False) -> Column:
    """Sorted distinct dictionary phrases in ``text``, whole words, any case; null text gives an empty array.

    A scan narrows the text to the few phrases in it, among which the pattern searches.
    """
    if scan and scans.plain(phrases):
        text = F.arrow_udf(scans.narrowed(phrases), "string")(text)
    return find_pattern(text, phrase_pattern(phrases))


def find_pattern(text: Column, pattern: str) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.sort_array(F.array_distinct(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1))))


def time_references(text: Column) -> Column:
    """Durations such as "2 weeks"."""
    units = "|".join(vocab.TIME_UNITS)
    return find_pattern(text, rf"{UNICODE}\b([0-9]+ (?:{units})s?)\b")


def entities(text: Column, issues: list[str] | None = None) -> Column:
    """``struct<components, issues, time_refs>`` of one review."""
    return F.struct(
        find_phrases(text, vocab.COMPONENTS).alias("components"),
        find_phrases(text, issues or vocab.ISSUES).alias("issues"),
        time_references(text).alias("time_refs"),
    )


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True if any phrase occurs in ``text`` as a substring, any case."""
    lowered = F.lower(text)
    return reduce(or_, (lowered.contains(p) for p in phrases))


def count_present(text: Column, phrases: list[str], scan: bool = False) -> Column:
    """How many of the phrases occur in ``text`` as substrings (each counts once); null text gives 0."""
    if scan and scans.plain(phrases):
        return F.arrow_udf(scans.phrase_numbers(phrases), "int")(text)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(add, (lowered.contains(p).cast("int") for p in phrases))


def complaint_score(text: Column, scan: bool = False) -> Column:
    return count_present(text, vocab.COMPLAINT_KEYWORDS, scan)


def word_places(spark: SparkSession, text: Column, dims: int) -> Column:
    """How often words of each place occur in ``text``, as a sparse vector, by a scan; a word's place is the start of its md5 modulo
    ``dims``."""
    return F.arrow_udf(scans.word_counts(dims, word_letters(spark)), VectorUDT())(F.lower(F.coalesce(text, F.lit(""))))


def packed_words(spark: SparkSession, text: Column, dims: int) -> Column:
    """What ``word_places`` counts, as a struct of bytes that ``phrases.unpacked`` reads."""
    packed = "struct<places: binary, counts: binary, many: binary>"
    return F.arrow_udf(scans.packed_words(dims, word_letters(spark)), packed)(F.lower(F.coalesce(text, F.lit(""))))


def word_letters(spark: SparkSession) -> np.ndarray:
    """Which characters outside ASCII make words, asked of Spark's own patterns, so that scans find the same."""
    codes = spark.range(0x80, 0x110000).filter(f"id NOT BETWEEN {0xD800} AND {0xDFFF}")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    return codes.filter(char.rlike(r"[\p{L}\p{N}]")).toPandas()["id"].to_numpy(np.int64)


def prefix(text: Column, length: int) -> Column:
    """The first ``length`` characters."""
    return F.substring(text, 1, length)


def exact_decimal(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals as text, halves decided on the binary value (half-even on ties)."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def exact_round(value: Column, digits: int) -> Column:
    return exact_decimal(value, digits).cast("double")


def without(text: Column, characters: str) -> Column:
    """``text`` without the given characters."""
    return F.translate(text, characters, "")


def word_count(text: Column, visible: Column) -> Column:
    """Words between white space. ASCII texts, told by their size, need the short pattern only."""
    ascii_only = F.octet_length(text) == F.length(text)
    parts = F.size(F.when(ascii_only, F.split(text, f"[{LATIN_SPACE}]+")).otherwise(F.split(text, f"[{SPACE}]+")))
    outer = sum(
        ((without(F.substring(text, position, 1), SPACE_CHARS) == "").cast("int") for position in (1, -1)), F.lit(0)
    )
    return F.when(visible == 0, 0).otherwise(parts - outer)


def style_inputs(text: Column) -> list[Column]:
    """Numbers that several style features use: characters that are no space, letters, words.

    They are counted by functions that loop inside (translate, split). Several regexp_replace calls in one projection
    make generated code too large to be compiled and run several times slower.
    """
    visible = F.length(without(text, SPACE_CHARS))
    return [
        visible.alias("_visible"),
        (F.length(text) - F.length(without(text, string.ascii_letters))).alias("_letters"),
        word_count(text, visible).alias("_words"),
    ]


def scanned_style_inputs(text: Column) -> Column:
    """A struct of what ``style_inputs`` counts, characters and capitals, by one scan."""
    return F.arrow_udf(scans.style_counts, "struct<chars: int, visible: int, words: int, letters: int, capitals: int>")(text)


def style_features(text: Column, title: Column, rating: Column, scan: bool = False) -> list[Column]:
    """The eight review style features, on rows that have ``style_inputs``, of a scan together with ``_chars`` and ``_capitals``."""
    capitals = F.col("_capitals") if scan else F.regexp_count(text, F.lit("[A-Z]"))
    return [
        (F.col("_chars") if scan else F.length(text)).alias("text_length"),
        F.col("_words").alias("word_count"),
        F.coalesce(rating, F.lit(3.0)).alias("rating"),
        F.length(F.coalesce(title, F.lit(""))).alias("title_length"),
        text.contains("!").cast("int").alias("has_exclamation"),
        text.contains("?").cast("int").alias("has_question"),
        F.coalesce(F.try_divide("_visible", "_words"), F.lit(0.0)).alias("avg_word_length"),
        F.coalesce(F.try_divide(capitals, F.col("_letters")), F.lit(0.0)).alias("uppercase_ratio"),
    ]


def rating_band(rating: Column) -> Column:
    return F.when(rating >= 4, "good").when(rating >= 3, "mid").otherwise("bad")


def similarity_band(similarity: Column) -> Column:
    return F.when(similarity > 0.7, "strong").when(similarity > 0.5, "medium").otherwise("weak")


def clip(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
