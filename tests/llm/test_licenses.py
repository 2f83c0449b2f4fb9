import random
import re
import time

from reviewmill.llm import licenses
from tests.llm import frames


def test_base_places_equal_a_word_by_word_search(spark):
    rng = random.Random(1)
    vocabulary = "mit license MIT License apache general public the é12 mitlicense".split()
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += frames.TEXTS
    got = sorted(licenses.scan(frames.documents(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower()))))
    for row, (key, text) in zip(got, rows):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            parts = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        assert row.doc_id == key and row.n_words == len(words) and row.n_base == len(places)
        assert row.first_word == min(places, default=None) and row.last_word == max(places, default=None)
        assert row.base_labels == ",".join(sorted(labels)) and labels <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score == 1 or not places)


def test_seeds_lose_no_match():
    scanner, rng = licenses.Scanner(), random.Random(2)
    vocabulary = "the mit license gnu public general released under by cc licensed apache lesser all rights reserved".split()
    for _ in range(600):
        words = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))
        notice = list(rng.choice(licenses.NOTICES)[0])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(notice))
            notice[at : at + 1] = rng.choice([["x"], [notice[at], "q"], [" "]])
        words = " ".join((words + " " + "".join(notice) + " and more").split())
        everywhere = {i: [(0, len(words))] for i in range(len(licenses.NOTICES))}
        assert scanner.fuzzy(words) == scanner.verified(words, everywhere)


def test_edits_and_spans():
    scanner, table = licenses.Scanner(), licenses.word_table()
    words = licenses.words_of("Text. Released under teh MIT-License!", table)
    assert scanner.fuzzy(words) == [{"label": "mit", "notice": "released under the mit license", "edits": 2, "first_word": 1, "last_word": 5}]
    assert scanner.fuzzy(licenses.words_of("a clean text about licences and rights", table)) == []


def test_empty_table(spark):
    assert licenses.scan(frames.empty(spark)).collect() == []


def test_a_text_of_ten_million_characters():
    """Word numbers of thousands of places are found in one walk through the text."""
    scanner, began = licenses.Scanner(), time.monotonic()
    words = "mit license " * 870_000 + "end"
    starts, labels = scanner.exact(words)
    assert starts == list(range(0, 1_740_000, 2)) and labels == {"mit"}
    words = ("lorem ipsum dolor sit amet " * 1000 + "relased under the mit licence ") * 360
    spans = scanner.fuzzy(words.strip())
    assert [s["first_word"] for s in spans] == [5000 + 5005 * i for i in range(360)] and {s["edits"] for s in spans} == {2}
    assert time.monotonic() - began < 60
