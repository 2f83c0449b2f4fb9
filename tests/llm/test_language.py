import math
import zlib

import pandas as pd
import pytest

from reviewmill.llm import language, registry
from tests.llm import frames


def count(texts):
    """Grams of languages to texts, as ``count_contexts`` gives them."""
    table, found = language.letters_table(), {}
    for name, lines in texts.items():
        for line in lines:
            data = language.PAD + language.normal(line, table)
            for i in range(len(data) - language.DEPTH):
                gram = int.from_bytes(data[i : i + language.DEPTH + 1])
                found[name, gram] = found.get((name, gram), 0) + 1
    return pd.DataFrame([(name, gram, n) for (name, gram), n in found.items()], columns=["label", "gram", "n"])


def chance(grams, alphabet, name, context, symbol, least_seen=1):
    """Straight from the definition: method C with exclusion; the bytes never seen are one symbol, None."""
    every = [*alphabet, None]

    def spread(context):
        if context is None:
            return {s: 1 / 256 for s in every}
        shorter = spread(context[1:] if context else None)
        at, seen = {}, 0
        for (label, gram), n in grams.items():
            data = gram.to_bytes(language.DEPTH + 1)
            if data[: language.DEPTH].endswith(context):
                seen += n  # in any language
                if label == name:
                    at[data[-1]] = at.get(data[-1], 0) + n
        if context and seen < least_seen:
            return shorter
        total = sum(at.values())
        if not total:
            return shorter
        left = sum(p for s, p in shorter.items() if s not in at)
        escape = len(at) / (total + len(at)) if left else 0
        return {s: at[s] / total * (1 - escape) if s in at else escape * shorter[s] / left for s in every}

    if any(c not in alphabet for c in context):  # nothing is known of contexts with such bytes but their known endings
        while any(c not in alphabet for c in context):
            context = context[1:]
    return spread(context)[symbol if symbol in alphabet else None]


@pytest.mark.parametrize("least_seen", [1, language.LEAST_SEEN, 3])
def test_lengths_equal_the_definition(least_seen):
    texts = {"a": ["banana band", "ban"], "b": ["anna nab", "bab abba"]}
    frame = count(texts)
    trees = language.ContextTrees(frame, least_seen=least_seen)
    grams = {(r.label, r.gram): r.n for r in frame.itertuples()}
    alphabet = {b for g in frame["gram"] for b in g.to_bytes(4)}
    lines = [b"ban", b"nab xanb", b"", b"z"]
    got = trees.lengths(lines)
    for line, row in zip(lines, got):
        data = language.PAD + line
        for name, bits in zip(trees.languages, row):
            exact = -sum(
                math.log2(chance(grams, alphabet, name, data[i - language.DEPTH : i], data[i], least_seen)) for i in range(language.DEPTH, len(data))
            )
            assert bits == pytest.approx(exact, rel=1e-5)


def test_chances_sum_to_one():
    trees = language.ContextTrees(count({"a": ["some text here"], "b": ["other words"]}))
    sums = (2.0 ** -trees.costs.reshape(-1, trees.size, 2)).sum(1)
    assert sums.ravel().tolist() == pytest.approx([1] * sums.size, abs=1e-4)


def test_windows_do_not_matter(monkeypatch):
    trees = language.ContextTrees(count({"a": ["some text here"], "b": ["other words"]}))
    lines = [b"some words", b"", b"there", b"xyz " * 50]
    whole = trees.lengths(lines)
    monkeypatch.setattr(language, "WINDOW", 7)
    assert trees.lengths(lines) == pytest.approx(whole)


def test_held_out_accuracy(spark):
    found = registry.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    merged = found.merge(docs, on="doc_id")
    assert (merged["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in merged["doc_id"]]).all()
    held = merged[merged["held_out"]]
    assert len(held) > 10 and (held["lang"] == held["lang_pred"]).mean() > 0.95


@pytest.fixture
def trees():
    return language.ContextTrees(count({"en": ["the quick brown fox jumps over the lazy dog", "text words"], "es": ["el niño está aquí"]}))


def test_messy_rows(spark, trees):
    got = frames.by_id(language.identify(frames.documents(spark), trees))
    assert [r["lang_pred"] for k in (2, 3, 4, 9) for r in got[k]] == ["und"] * 4
    assert [r["score"] for k in (2, 3, 4, 9) for r in got[k]] == [0.0] * 4
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[1][0]["lang_pred"] == "en"
    assert len(got[None]) == 3 and 0 <= got[5][0]["score"] <= 1


def test_kept_rows_and_empty_tables(spark, trees):
    docs = frames.documents(spark)
    kept = language.keep_identified(docs, trees)
    assert kept.columns == docs.columns and not {2, 3, 4, 9} & {r.doc_id for r in kept.collect()}
    assert language.identify(frames.empty(spark), trees).collect() == []


def test_a_close_decision_is_kept(spark):
    trees = language.ContextTrees(count({name: ["text words"] for name in "abc"}))
    docs = spark.createDataFrame([(1, "De."), (2, "12")], "doc_id long, text string")
    assert language.identify(docs.filter("doc_id = 1"), trees).first()["score"] < 0.5
    assert [r.doc_id for r in language.keep_identified(docs, trees).collect()] == [1]


def test_nothing_to_learn_from(spark):
    trees = language.learn(frames.documents(spark).drop("lang").selectExpr("*", "cast(null as string) AS lang"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language.identify(frames.documents(spark), trees).collect()} == {"und"}
