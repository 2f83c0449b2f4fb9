"""Encoders for the vocabulary files of public tokenizers, with the ids of the tokenizers library.

Merges run in tiktoken, which merges by the rank of the joined bytes. That equals merging by pairs if every token of the
vocabulary encodes to itself, which the tests check for each file used.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Regex, normalizers, pre_tokenizers

# Fixed value: how byte-level vocabularies split a text.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the code points of white space.
SPACES = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LONG_RUN = 100_000  # the look-ahead above keeps a step per character of white space and gives up after 1,000,000


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a vocabulary file, to the byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[str, int], dict[str, int]]:
    """Tokens with their ids, and the special tokens with theirs."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    return {t: i for t, i in content["model"]["vocab"].items() if t not in special}, special


class ByteLevel:
    """Ids of a text under a byte-level vocabulary; special tokens in the text have their own ids.

    Runs of white space longer than ``LONG_RUN`` are split off as the pattern would: all but the last character if
    something follows, else the whole run.
    """

    def __init__(self, path: str):
        vocabulary, special = read_vocabulary(path)
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in token): i for token, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.spaces = re.compile("[" + "".join(map(re.escape, sorted(SPACES))) + "]{64,}")
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> np.ndarray:
        parts = self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]
        found = [
            np.array([self.special[part]], np.uint32) if part in self.special else self._plain(part)
            for part in parts if part
        ]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        found, at = [], 0
        for run in self.spaces.finditer(text) if len(text) > LONG_RUN else ():
            if run.end() - run.start() > LONG_RUN:
                end = run.end() - (run.end() < len(text))
                found.append(self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
                found.append(np.array(self.encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
                at = end
        last = self.encoding.encode_to_numpy(text[at:], disallowed_special=())
        return np.concatenate([*found, last]) if found else last


class WordSplitter:
    """Words of texts as the word-level vocabulary splits them: NFC, lower case, white space dropped.

    The classes of the pattern are spelled out for the characters that occur, as the standard library's regular
    expressions have no classes by category. Texts with characters that its tables do not have yet, for which the tokenizers
    library may have classes and lower case, are normalised and split by that library.
    """

    ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed value

    def __init__(self):
        self.chars: frozenset[str] = frozenset()
        self.raw: frozenset[str] = frozenset()
        self.newer: frozenset[str] = frozenset()
        self.find = re.compile(self.ENDINGS).findall
        self.normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        pattern = Regex(self.ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.split = pre_tokenizers.Split(pattern, "removed", invert=True).pre_tokenize_str

    def __call__(self, texts: list[str]) -> list[list[str]]:
        raw = frozenset().union(*texts)
        if not raw <= self.raw:
            self.newer |= {c for c in raw - self.raw if unicodedata.category(c) == "Cn"}
            self.raw |= raw
        if raw & self.newer:
            rare = [not self.newer.isdisjoint(t) for t in texts]
            plain = iter(self._known([t for t, new in zip(texts, rare) if not new]))
            return [self._newer(t) if new else next(plain) for t, new in zip(texts, rare)]
        return self._known(texts)

    def _newer(self, text: str) -> list[str]:
        return [word for word, _ in self.split(self.normalise(text))]

    def _known(self, texts: list[str]) -> list[list[str]]:
        plain = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        chars = frozenset().union(*plain)
        if not chars <= self.chars:
            self.chars |= chars
            self.find = self._compile()
        return [self.find(t) for t in plain]

    def _compile(self):
        letters, digits, others = [], [], []
        for c in sorted(self.chars - SPACES):
            kind = unicodedata.category(c)[0]
            (letters if kind == "L" else digits if kind == "N" else others).append(re.escape(c))
        parts = ["[" + "".join(letters) + "]+"] * bool(letters) + [self.ENDINGS]
        parts += ["[" + "".join(digits) + "]"] * bool(digits) + ["[" + "".join(others) + "]+"] * bool(others)
        return re.compile("|".join(parts)).findall


class WordMerger:
    """Ids of a word by merges. The end of a word is a byte that no UTF-8 text has, so its merges are ranks like all others."""

    END, END_SIGN = b"\xff", "</w>"

    def __init__(self, path: str):
        vocabulary, self.special = read_vocabulary(path)
        signs = byte_signs()
        self.names = {i: t for t, i in (vocabulary | self.special).items()}

        def as_bytes(token: str) -> bytes:
            inner = token.removesuffix(self.END_SIGN)
            return bytes(signs[c] for c in inner) + (self.END if inner != token else b"")

        ranks = {as_bytes(t): i for t, i in vocabulary.items()}
        encoding = tiktoken.Encoding("word level", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.merge = encoding._core_bpe.encode_single_piece

    def __call__(self, word: str) -> list[int]:
        return self.merge(word.encode() + self.END)

    def text(self, ids: list[int]) -> str:
        """What decoding shows: the tokens with a space between them."""
        return " ".join([self.names[i] for i in ids])
