import json

import pandas as pd

from reviewmill import vocab
from reviewmill.operators import model_calls as mc


def frame(spark, contents):
    return spark.createDataFrame(list(enumerate(contents)), "id long, content string")


def reference_labels(content):
    start, end = content.find("{"), content.rfind("}") + 1
    try:
        parsed = json.loads(content[start:end]) if start >= 0 and end > start else {}
    except ValueError:
        parsed = {}
    return [int(parsed.get(c, 0) == 1) for c in vocab.LABELS]


def test_parse_labels(spark):
    contents = [
        'Sure {"defect": 1, "price": 0} ok', '{"defect": true, "size": 1.0}', "none", '{"defect": "1", "price": 2}', '{"shipping": 1',
        '} {"size": 1}', '{"defect": null}', '{"defect": [1]}', '{"a": {"defect": 1}}', '{"price": 1e0}', "} {", "{}",
    ]
    rows = mc.parse_labels(frame(spark, contents)).orderBy("id").collect()
    assert [[r[c] for c in vocab.LABELS] for r in rows] == [reference_labels(c) for c in contents]


def test_parse_judgements(spark):
    contents = [
        '{"accuracy": 5, "completeness": 4, "actionability": 3, "conciseness": 2}', '{"accuracy": 0, "completeness": 9}',
        '{"accuracy": "4"}', '{"accuracy": null, "completeness": 5}', "no", '{"accuracy": "high", "completeness": 5}', '{"accuracy": 1',
    ]
    rows = mc.parse_judgements(frame(spark, contents)).orderBy("id").collect()
    got = [[r[c] for c in vocab.CRITERIA] + [r["overall_score"]] for r in rows]
    assert got[0] == [5, 4, 3, 2, 3.5] and got[1] == [1, 5, 3, 3, 3.0] and got[2] == [4, 3, 3, 3, 3.25]
    assert all(g == [3.0] * 5 for g in got[3:])


def test_parse_rewrites(spark):
    originals = spark.createDataFrame([(str(i), "T", "D") for i in range(5)], "asin string, product_title string, product_description string")
    answers = spark.createDataFrame(
        [("0", 'x {"title": "A", "description": "B", "changes": ["c", "d"]}'), ("1", " plain "), ("2", '{"title": "A"}'), ("3", "{bad}")],
        "id string, content string",
    )
    rows = {r["asin"]: tuple(r)[1:] for r in mc.parse_rewrites(originals, answers).collect()}
    assert rows == {
        "0": ("A", "B", ["c", "d"]), "1": ("T", "plain", ["Full rewrite generated"]), "2": ("A", "D", []),
        "3": ("T", "D", ["Rewrite failed: invalid JSON"]),
    }


def test_summary_input_text(spark):
    reviews = spark.createDataFrame(
        [(1, "a", 3, 5.0, "Nice", "x" * 400), (2, "a", 9, 1.0, None, "bad"), (3, "a", None, None, "T", "y"), (4, "a", 1, 2.0, "T", None)],
        "id long, asin string, helpful_votes int, rating double, title string, text string",
    )
    titles = spark.createDataFrame([("a", None)], "asin string, product_title string")
    text = mc.summary_inputs(reviews, titles).first()["input"]
    assert text == (
        "Product: Unknown\n\nTotal reviews shown: 3\n\nNegative (1-2 stars): 1 | Positive (4-5 stars): 1\n\n---\n\n"
        "[1 stars] \nbad\n\n[5 stars] Nice\n" + "x" * 300 + "\n\n[0 stars] T\ny\n")
    assert mc.summary_inputs(reviews, titles, 1).first()["shown"] == 1


def test_client_runs_per_batch(spark):
    requests = mc.label_requests(frame(spark, ["Broken!", "overpriced"]).withColumnRenamed("content", "text"))
    upper = mc.call_model(requests, lambda: lambda batch: pd.Series(batch["user"]).str.upper())
    assert {r["id"]: r["content"] for r in upper.collect()} == {0: "BROKEN!", 1: "OVERPRICED"}
    rows = mc.parse_labels(mc.call_model(requests, mc.stub_label_client)).orderBy("id").collect()
    assert rows[0]["defect"] == 1 and rows[0]["price"] == 0 and rows[1]["price"] == 0


def test_label_text_is_cut_for_the_prompt_only(spark):
    row = mc.label_requests(frame(spark, ["z" * 1500]).withColumnRenamed("content", "text")).first()
    assert len(row["user"]) == 1000 and all(c in row["system"] for c in vocab.LABELS)


def test_tuning_text(spark):
    pairs = spark.createDataFrame([("a", "t", "i" * 2500, "s")], "asin string, product_title string, input string, summary string")
    text = mc.tuning_texts(pairs).first()["text"]
    assert text.startswith("<s>[INST] ") and text.endswith("i\n[/INST]\ns</s>") and text.count("i" * 2000) == 1
