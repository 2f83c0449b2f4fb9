"""License scan: base phrases as consecutive words, and short notices with a bounded number of edits.

A text is read as its words, lower-cased, with one space between. Base phrases must stand there word by word. A notice may
differ by up to its number of edits (inserted, dropped or changed characters): cut into one part more than that, at least
one part stands unchanged, so exact occurrences of the parts (found together by an Aho-Corasick automaton) are the only
places to look at. There the regex library searches the notice with bounded errors and reports the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices that are searched with edits, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license", "apache"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("boost software license", "boost"),
    ("licensed under cc by", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
    ("the above copyright notice and this permission notice shall be included in all copies", "mit"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms", "gpl"),
    ("redistributions of source code must retain the above copyright notice", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons zero", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("the artistic license", "artistic"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("sil open font license", "ofl"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("microsoft public license", "ms-pl"),
)
CHARACTERS_PER_EDIT = 10
SPAN = "struct<label:string,notice:string,edits:int,first_word:bigint,last_word:bigint>"


class WordNumbers:
    """Numbers of the words of a line by position. Asked in ascending order it counts every part of the line once."""

    def __init__(self, line: str):
        self.line, self.at, self.number = line, 0, 0

    def __call__(self, at: int) -> int:
        if at < self.at:
            self.at = self.number = 0
        self.number += self.line.count(" ", self.at, at)
        self.at = at
        return self.number


def edits_for(notice: str) -> int:
    return max(1, len(notice) // CHARACTERS_PER_EDIT)


def word_table() -> bytes:
    """Digits, letters in lower case and bytes from 0x80 stay, all else is a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None, table: bytes) -> str:
    """The words of a text with a space between them."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(table).split()).decode()


class Scanner:
    """Patterns and automaton; one object per task."""

    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(f" {phrase} ", label) for phrase, label in base]
        self.notices = [
            (text, label, edits_for(text), regex.compile(f"(?e)(?<=^| )(?:{regex.escape(text)}){{e<={edits_for(text)}}}(?= |$)"))
            for text, label in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (text, _, edits, _) in enumerate(self.notices):
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for low, high in zip(cuts, cuts[1:]):
                seeds.setdefault(text[low:high], []).append((number, low))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def exact(self, words: str) -> tuple[list[int], set[str]]:
        """First words of all places of base phrases, and their labels."""
        line, starts, labels = f" {words} ", [], set()
        for phrase, label in self.base:
            at, number = line.find(phrase), WordNumbers(line)
            while at >= 0:
                starts.append(number(at))
                labels.add(label)
                at = line.find(phrase, at + 1)
        return starts, labels

    def windows(self, words: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice the merged ranges of ``words``, from word to word, that can hold it."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(words):
            for number, offset in places:
                text, _, edits, _ = self.notices[number]
                low = max(0, end - size + 1 - offset - edits)
                high = words.find(" ", min(len(words), low + len(text) + 4 * edits))
                found.setdefault(number, []).append((words.rfind(" ", 0, low) + 1, len(words) if high < 0 else high))
        for number, ranges in found.items():
            merged: list[tuple[int, int]] = []
            for low, high in sorted(ranges):
                if merged and low <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
                else:
                    merged.append((low, high))
            found[number] = merged
        return found

    def verified(self, words: str, windows: dict[int, list[tuple[int, int]]]) -> list[dict]:
        """Spans of notices in the windows, leftmost first, those of one notice without overlaps."""
        spans = []
        for number in sorted(windows):
            text, label, _, pattern = self.notices[number]
            place = WordNumbers(words)
            for low, high in windows[number]:
                for match in pattern.finditer(words, low, high):
                    inner = match.group().strip(" ")
                    first = place(match.start() + match.group().index(inner))
                    spans.append(
                        {"label": label, "notice": text, "edits": sum(match.fuzzy_counts), "first_word": first, "last_word": first + inner.count(" ")}
                    )
        return spans

    def fuzzy(self, words: str) -> list[dict]:
        return self.verified(words, self.windows(words))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """For every row: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start. ``labels``
    adds those of the notices, whose spans are listed. score is 1 with a base phrase, else 1 less the edits per character
    of the best notice, else 0. A null text counts as empty; an empty label list is an empty text.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        f" score double, spans array<{SPAN}>"
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, table = Scanner(base, notices), word_table()
        for batch in batches:
            rows = []
            for content in batch.column(1):
                words = words_of(content.as_py(), table)
                starts, labels = scanner.exact(words)
                spans = scanner.fuzzy(words)
                similar = max((1 - s["edits"] / len(s["notice"]) for s in spans), default=0.0)
                rows.append(
                    (
                        words.count(" ") + 1 if words else 0, len(starts), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(labels)), ",".join(sorted(labels | {s["label"] for s in spans})),
                        1.0 if starts else similar, spans,
                    )
                )
            whole, word, real = pa.int64(), pa.string(), pa.float64()
            span = pa.struct([("label", word), ("notice", word), ("edits", pa.int32()), ("first_word", whole), ("last_word", whole)])
            kinds = [whole, whole, whole, whole, word, word, real, pa.list_(span)]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *NAMES])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(look, schema).withColumnRenamed("key", key)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
