import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import text as tx
from reviewmill.operators import aggregates, helpfulness, rootcause

def extract(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = rows.select("i", tx.entities(F.col("text")).alias("e")).orderBy("i").collect()
    return [r["e"].asDict() for r in found]


EMPTY = {"components": [], "issues": [], "time_refs": []}


def test_every_phrase_is_found_alone_between_signs_and_in_capitals(spark):
    cases = [("components", p) for p in vocab.COMPONENTS] + [("issues", p) for p in vocab.ISSUES]
    found = extract(spark, [f"({p.upper()})/{p};" for _, p in cases])
    for (kind, phrase), got in zip(cases, found):
        assert got[kind] == [phrase] and got["time_refs"] == []


def test_the_longest_phrase_at_a_place_wins(spark):
    cases = [(long, short) for long in vocab.ISSUES for short in vocab.ISSUES if long != short and long.startswith(short + " ")]
    cases += [("dead pixels", "dead"), ("short battery life", "short")]
    for (long, short), got in zip(cases, extract(spark, [f"x {long} x" for long, _ in cases])):
        assert long in got["issues"] and short not in got["issues"]
    both = extract(spark, [f"{short}, {long}" for long, short in cases])
    assert all({long, short} & set(vocab.ISSUES) <= set(got["issues"]) for (long, short), got in zip(cases, both))


def test_parts_of_words_are_no_phrases(spark):
    cases = [("components", p) for p in vocab.COMPONENTS] + [("issues", p) for p in vocab.ISSUES]
    found = extract(spark, [text for _, p in cases for text in (f"q{p}", f"{p}q")])
    assert not any(p in got[kind] for i, (kind, p) in enumerate(cases) for got in found[2 * i : 2 * i + 2])
    dashed = extract(spark, [f"un-{p}-like" for p in vocab.COMPONENTS])
    assert all(p in got["components"] for p, got in zip(vocab.COMPONENTS, dashed))


def test_results_are_sorted_without_repeats(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        chosen = [str(p) for p in rng.choice(vocab.COMPONENTS, 12)]
        got = extract(spark, [" | ".join(chosen)])[0]
        assert got == {"components": sorted(set(chosen)), "issues": [], "time_refs": []}


def test_amounts_of_time(spark):
    units = [u + s for u in vocab.TIME_UNITS for s in ("", "s")]
    found = extract(spark, [f"{i} {u}, {i}{u}, a {u}, x{i} {u}" for i, u in enumerate(units)])
    assert [got["time_refs"] for got in found] == [[f"{i} {u}"] for i, u in enumerate(units)]


def test_texts_without_anything(spark):
    assert extract(spark, ["", None, " ", "all went well", "0123456789"]) == [EMPTY] * 5


def test_accented_letters_belong_to_words(spark):
    found = extract(spark, ["éfan portö über-fan", "diedé 2 weeksé", "fan"])
    assert [f["components"] for f in found] == [["fan"], [], ["fan"]]
    assert found[1] == {"components": [], "issues": [], "time_refs": []}
    reviews = spark.createDataFrame([("café éfan über l'eau 日本 x",)], "text string").withColumn("rating", F.lit(1.0))
    words = {r["word"] for r in aggregates.word_frequencies(reviews).collect()}
    assert words == {"café", "éfan", "über", "l'eau", "日本"}


def test_whole_words_against_substrings(spark):
    rows = spark.createDataFrame([("I returned it; returning is easy. CRACKED! wi-fi",)], "text string")
    row = rows.select(
        tx.find_phrases(F.col("text"), vocab.ISSUES).alias("issues"),
        tx.find_phrases(F.col("text"), vocab.COMPONENTS).alias("components"),
        tx.complaint_score(F.col("text")).alias("n"),
    ).first()
    assert row["issues"] == ["cracked", "returned"] and row["components"] == ["wi-fi"] and row["n"] == 1


PIECES = st.sampled_from(vocab.ISSUES + ["s", "'", "-", "é", "_", ".", "a", "dead", "pixel"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, st.sampled_from([" ", "", ", "])), max_size=8))
def test_shared_prefix_pattern_equals_plain_alternation(parts):
    text = "".join(a + b for a, b in parts)
    plain = "|".join(map(re.escape, sorted(vocab.ISSUES, key=len, reverse=True)))
    assert re.findall(tx.phrase_pattern(vocab.ISSUES).removeprefix(tx.UNICODE), text) == re.findall(rf"\b({plain})\b", text)


def test_rule_scores(spark):
    rows = spark.createDataFrame([("Broken, defective, dead, crashed. not as described",), ("broke: doesn't fit",), (None,)], "text string")
    first, second, third = rows.select(*rootcause.rule_scores(F.col("text"))).collect()
    assert first["defect"] == 1.0 and first["description"] == 0.3 and first["price"] == 0.0
    assert second["size"] == 0.3 and second["defect"] == 0.0
    assert sum(third) == 0
    percents = rows.select(*rootcause.rule_percents(F.col("text"))).collect()
    assert percents[0]["defect"] == 100 and percents[1]["defect"] == 20 and percents[1]["size"] == 20


def test_three_hits_score_point_nine(spark):
    rows = spark.createDataFrame([("broken and dead and freezing",)], "text string")
    assert rows.select(*rootcause.rule_scores(F.col("text"))).first()["defect"] == 0.9


def test_style_features_follow_python(spark):
    texts = ["", "  two  words ", "ÀB c　d e!", " x ", "no?", "\n\t ", "one", "A\x1cB\x85C", None, "a.b  C!?"]
    rows = [(i, t, None if i % 2 else "Title", None if i % 3 else 4.0, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, title string, rating double, helpful_votes int")
    for row, (_, text, title, rating, _) in zip(helpfulness.style_table(df).orderBy("id").collect(), rows):
        text, words = text or "", (text or "").split()
        letters = sum(c in string.ascii_letters for c in text)
        assert row["text_length"] == len(text) and row["word_count"] == len(words)
        assert row["avg_word_length"] == pytest.approx(np.mean([len(w) for w in words]) if words else 0.0)
        assert row["uppercase_ratio"] == pytest.approx(sum(c in string.ascii_uppercase for c in text) / (letters or 1))
        assert row["has_exclamation"] == ("!" in text) and row["has_question"] == ("?" in text)
        assert row["rating"] == (rating or 3.0) and row["title_length"] == len(title or "")


def test_decimals_follow_python(spark):
    values = [2.675, 2.125, 1.005, 0.25, 0.35, 12345.678, 3.0, 0.0, 66.65, 1e-9, 100.0, 2.345]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", tx.exact_decimal(F.col("v"), 2).alias("two"), tx.exact_decimal(F.col("v"), 1).alias("one")).collect():
        assert row["two"] == f"{row['v']:.2f}" and row["one"] == f"{row['v']:.1f}"


ODD = ["é", "ö", "_", "'", "-", " ", " ", ". ", "́", "‍", "日本", "İ", "K", "9", "s", "Ⓐ", "\U0001f600", "keeps ", "no ", "dead ", "wi"]


def test_scanned_texts_give_what_the_pattern_finds(spark):
    rng = np.random.default_rng(4)
    words = vocab.ISSUES + vocab.COMPONENTS + [p.upper() for p in vocab.COMPLAINT_KEYWORDS]
    parts = [["".join(map(str, rng.choice(ODD if rng.random() < 0.5 else words, 2))) for _ in range(rng.integers(0, 5))] for _ in range(2000)]
    df = spark.createDataFrame([(None if i % 50 == 0 else "".join(p),) for i, p in enumerate(parts)], "text string").coalesce(1)
    text, lowered = F.col("text"), F.lower(F.coalesce("text", F.lit("")))
    for phrases in (vocab.ISSUES, vocab.COMPONENTS):
        pattern = tx.find_pattern(text, tx.phrase_pattern(phrases))
        assert df.filter(~tx.find_phrases(text, phrases, scan=True).eqNullSafe(pattern)).isEmpty()
    present = sum((lowered.contains(p).cast("int") for p in vocab.COMPLAINT_KEYWORDS), F.lit(0))
    assert df.filter(~tx.complaint_score(text, scan=True).eqNullSafe(present)).isEmpty()


def test_patterns_search_narrowed_texts_only(spark):
    plan = spark.range(1).select(tx.find_phrases(F.col("id").cast("string"), vocab.ISSUES, scan=True))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.index("regexp_extract_all(") < plan.index("ArrowEvalPython")


def test_a_scan_gives_the_native_style_features(spark):
    texts = ["", "  two  words ", "ÀB c\u3000d e!", "\u00a0x ", "no?", "\n\t ", "A\x1cB\x85C", None, "a.b  C!?", "日本 é\u2003"]
    df = spark.createDataFrame([(i, t, "T", 1.0, 1) for i, t in enumerate(texts)], "id long, text string, title string, rating double, helpful_votes int")
    native, scanned = (helpfulness.style_table(df, scan) for scan in (False, True))
    assert native.dtypes == scanned.dtypes and native.exceptAll(scanned).isEmpty() and scanned.count() == len(texts)
