"""Counts and dictionary phrases of whole texts, worked out on the bytes of many texts at once inside tasks."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20  # bytes looked at together
BUCKETS = 8
LETTERS, CAPITALS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = bytes.maketrans(CAPITALS, LETTERS)
# The letters outside ASCII whose lower case is, or starts with, an ASCII letter.
TO_ASCII = {"K": "k", "İ": "i̇"}
CIRCLED = [(0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)]
SPACES = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
EIGHT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first i bytes of eight
MANY = 255
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
PLAIN = re.compile(r"[a-z0-9_][\x20-\x40\x5b-\x7e]+[a-z0-9_]")


def plain(phrases: list[str]) -> bool:
    """Whether ``Scanner`` knows such phrases: lower-case ASCII of at least three bytes, word characters at both ends."""
    return bool(phrases) and all(PLAIN.fullmatch(p) for p in phrases)


def table(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets. A null has no bytes."""
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    if not len(wide) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def windows(offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``size`` bytes in all, or of a single longer row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high
        low = high


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` in lower case as far as ASCII letters come of it; other letters stay."""
    data, offsets = flat(column)
    whole = data.tobytes()
    if any(letter.encode() in whole for letter in TO_ASCII):
        for letter, small in TO_ASCII.items():
            column = pc.replace_substring(column, letter, small)
        data, offsets = flat(column)
    return data, offsets


def is_word(char: str) -> bool:
    """Letters, marks, digits, connectors: what has no word boundary to a letter in Java's Unicode mode."""
    kind = unicodedata.category(char)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or char in "‌‍" or any(a <= ord(char) <= b for a, b in CIRCLED)


class Scanner:
    """Finds lower-case ASCII phrases: everywhere, or as whole words, of which the longest at the first place counts."""

    def __init__(self, phrases: list[str], words: bool):
        self.phrases = sorted({p.encode() for p in phrases})
        self.words, self.word = words, table(LETTERS + CAPITALS + b"0123456789_")
        self.apart = np.where(self.word, 0, 255).astype(np.uint8).tobytes()
        # bit b of masks[i][byte]: some phrase of bucket b has this byte at place i
        masks = np.zeros((3, 256), np.uint8)
        heads = sorted({p[:3] for p in self.phrases})
        for number, head in enumerate(heads):
            for i, byte in enumerate(head):
                masks[i, byte] |= 1 << (number * BUCKETS // len(heads))
        self.masks = [mask.tobytes() for mask in masks]

    def _starts(self, small: bytes, offsets: np.ndarray) -> np.ndarray:
        """Places where a phrase may start."""
        first, second, third = (np.frombuffer(small.translate(mask), np.uint8) for mask in self.masks)
        may = first[:-2] & second[1:-1] & third[2:]
        if self.words:
            before = np.frombuffer(small.translate(self.apart), np.uint8).copy()
            before[offsets[1:-1] - 1] = 255  # the last byte of another text
            may[1:] &= before[:-3]
        return np.flatnonzero(may != 0)

    def _char(self, data: np.ndarray, at: int, step: int) -> str:
        """The character outside ASCII that starts (step 1) or ends (step -1) at a byte."""
        low = at
        while step < 0 and data[low] & 0xC0 == 0x80:
            low -= 1
        size = 2 + (data[low] >= 0xE0) + (data[low] >= 0xF0)
        return data[low : low + int(size)].tobytes().decode("utf-8", "replace")[:1]

    def _bounded(self, data: np.ndarray, places: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
        """Whether the byte at each place is beyond the text (``edge``) or belongs to no word character."""
        out = edge.copy()
        inside = np.flatnonzero(~edge)
        byte = data[places[inside]]
        out[inside] = ~self.word[byte] & (byte < 0x80)
        for i in inside[byte >= 0x80]:
            out[i] = not is_word(self._char(data, int(places[i]), step))
        return out

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and phrase numbers of what is found in the texts of a window."""
        small = data.tobytes().translate(SMALL)
        data = np.frombuffer(small, np.uint8)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = self._starts(small, offsets) if len(data) >= 3 else none[0]
        if not len(starts):
            return none
        row = np.searchsorted(offsets, starts, "right") - 1
        room = offsets[row + 1] - starts
        head = data[starts].astype(np.int32) << 16 | data[starts + 1].astype(np.int32) << 8 | data[starts + 2]
        order = np.argsort(head, kind="stable")
        heads, found = head[order], []
        for number, phrase in enumerate(self.phrases):
            key, size = int.from_bytes(phrase[:3], "big"), len(phrase)
            at = order[np.searchsorted(heads, key) : np.searchsorted(heads, key, "right")]
            at = at[room[at] >= size]
            if len(at):
                places = starts[at, None] + np.arange(3, size)
                at = at[(data[places] == np.frombuffer(phrase[3:], np.uint8)).all(axis=1)]
            if len(at) and self.words:
                at = at[self._bounded(data, starts[at] - 1, starts[at] == offsets[row[at]], -1)]
                at = at[self._bounded(data, starts[at] + size, room[at] == size, 1)]
            if len(at):
                found.append((starts[at], np.full(len(at), size), row[at], np.full(len(at), number)))
        if not found:
            return none
        start, size, row, number = (np.concatenate(x) for x in zip(*found))
        if self.words:
            order = np.lexsort((-size, start))
            start, size, row, number = start[order], size[order], row[order], number[order]
            keep = _apart(start, start + size)
            row, number = row[keep], number[keep]
        return row, number

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, phrase number) pairs of a column, in order."""
        data, offsets = lowered(column)
        pairs = []
        for low, high in windows(offsets):
            row, number = self.find(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            pairs.append(np.unique((row + low) * len(self.phrases) + number))
        return np.divmod(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), len(self.phrases))


def _apart(start: np.ndarray, end: np.ndarray) -> list[int]:
    """The matches a search from left to right takes: the first, and each next one from where the last ended."""
    keep, last = [], 0
    for i, (low, high) in enumerate(zip(start.tolist(), end.tolist())):
        if low >= last:
            keep.append(i)
            last = high
    return keep


def narrowed(phrases: list[str]) -> Callable[[pa.Array], pa.Array]:
    """The distinct phrases of each text as whole words, a line each: all that is left of it to search."""
    scanner = Scanner(phrases, words=True)
    names = pa.array([p.decode() for p in scanner.phrases], pa.string())

    def find(texts: pa.Array) -> pa.Array:
        row, number = scanner(texts)
        offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(number))), "\n")

    return find


def phrase_numbers(phrases: list[str]) -> Callable[[pa.Array], pa.Array]:
    """How many distinct phrases occur in each text as substrings."""
    scanner = Scanner(phrases, words=False)

    def count(texts: pa.Array) -> pa.Array:
        row, _ = scanner(texts)
        return pa.array(np.bincount(row, minlength=len(texts)).astype(np.int32))

    return count


def style_counts(texts: pa.Array) -> pa.Array:
    """Characters, characters that are no white space, words between white space, letters and capitals of ASCII."""
    sums = np.zeros((5, len(texts)), np.int64)
    data, offsets = flat(texts)
    spaces = table(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
    tables = [table(bytes(b for b in range(256) if b & 0xC0 != 0x80)), None, None, table(LETTERS + CAPITALS), table(CAPITALS)]
    marks = [None if t is None else t.tobytes() for t in tables]
    for low, high in windows(offsets):
        if offsets[low] == offsets[high]:
            continue
        part, at = data[offsets[low] : offsets[high]].tobytes(), offsets[low : high + 1] - offsets[low]
        space = np.frombuffer(part.translate(spaces.tobytes()), bool).copy()
        first = np.frombuffer(part.translate(marks[0]), bool)
        for char in (c.encode() for c in SPACES) if not part.isascii() else ():
            place = part.find(char)
            while place >= 0:
                space[place : place + len(char)] = True
                place = part.find(char, place + len(char))
        visible = first & ~space
        start = visible.copy()
        start[1:] &= space[:-1]
        edges = at[:-1][np.diff(at) > 0]
        start[edges] = visible[edges]
        counted = [first, visible, start, *(np.frombuffer(part.translate(mark), bool) for mark in marks[3:])]
        rows = low + np.flatnonzero(np.diff(at) > 0)
        for sum_of, mask in zip(sums, counted):
            sum_of[rows] = np.add.reduceat(mask, edges, dtype=np.int64)
    names = ["chars", "visible", "words", "letters", "capitals"]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in sums], names)


class WordPlaces:
    """Counts the words of texts by the start of their md5 modulo ``dims``: what the pattern ``WORD`` of ``text`` finds, that is
    letters, digits, "_" and, not in front, "'", two characters at least. ``letters`` are the letters and digits outside ASCII."""

    KNOWN, BYTES = 1 << 19, 2 * WINDOW  # words whose place is remembered; bytes whose words are told apart together
    SLOTS, SHORT = 1 << 20, 16  # of a table of words of at most so many bytes, a slot holds the last one met

    def __init__(self, dims: int, letters: np.ndarray):
        self.dims, self.places, self.slots = dims, {}, None
        self.inside = table(LETTERS + CAPITALS + b"0123456789_'").tobytes()
        beyond = np.zeros(0x110000, bool)
        beyond[letters] = True
        self.beyond = np.packbits(beyond)

    def _members(self, part: bytes, data: np.ndarray) -> np.ndarray:
        """Which bytes belong to characters of words."""
        inside = np.frombuffer(part.translate(self.inside), bool)
        if part.isascii():
            return inside
        inside, lead = inside.copy(), np.flatnonzero(data >= 0xC0)
        size = _size(data[lead])
        code = data[lead].astype(np.int32) & (0x7F >> size)
        for i in (1, 2, 3):
            more = size > i
            code[more] = code[more] << 6 | data[lead[more] + i] & 0x3F
        found = (self.beyond[code >> 3] >> (7 - (code & 7)) & 1).astype(bool)
        for i in range(4):
            inside[lead[found & (size > i)] + i] = True
        return inside

    def split(self, part: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in the texts of a window."""
        data = np.frombuffer(part, np.uint8)
        inside = self._members(part, data)
        change = np.ones(len(data) + 1, bool)
        np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
        change[offsets] = True
        bounds = np.flatnonzero(change)
        real = inside[bounds[:-1]]
        starts, ends = bounds[:-1][real], bounds[1:][real]
        quoted = data[starts] == 39
        if quoted.any():
            solid = np.append(np.flatnonzero(data != 39), len(data))
            starts[quoted] = np.minimum(solid[np.searchsorted(solid, starts[quoted])], ends[quoted])
        keep = ends - starts > _size(data[np.minimum(starts, len(data) - 1)])
        return starts[keep], ends[keep]

    def _place(self, word: bytes) -> int:
        place = self.places.get(word)
        if place is None:
            if len(self.places) >= self.KNOWN:
                self.places.clear()
            place = self.places[word] = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big") % self.dims
        return place

    def _distinct(self, part: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words from ``starts`` to ``ends``, worked out once for equal words."""
        # The words are every other value of one array over the bytes; what lies between them is null.
        bounds = np.stack([starts, ends], axis=1).ravel()
        valid = pa.py_buffer(b"\x55" * (len(starts) // 4 + 1))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [valid, pa.py_buffer(bounds), pa.py_buffer(part)])
        coded = words.dictionary_encode()
        places = np.fromiter(map(self._place, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return places[np.frombuffer(coded.indices.buffers()[1], np.int32)[: len(bounds) - 1 : 2]]

    def _places(self, part: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words from ``starts`` to ``ends``. A short word is two numbers, its bytes filled up with zeros, which no
        word has; a slot of the table is chosen by both and compared with both."""
        if self.slots is None:
            self.slots = np.zeros((2, self.SLOTS), np.uint64), np.zeros(self.SLOTS, np.int32)
        keys, known = self.slots
        size, eight = ends - starts, np.ndarray(len(part) + 8, "<u8", part + bytes(16), strides=(1,))
        first = eight[starts] & EIGHT[np.minimum(size, 8)]
        second = eight[np.minimum(starts + 8, len(part))] & EIGHT[np.clip(size - 8, 0, 8)]
        slot = ((first * MIX[0] ^ second * MIX[1]) >> np.uint64(32)).astype(np.int64) % self.SLOTS
        place, short = known[slot], size <= self.SHORT
        rest = np.flatnonzero(~(short & (keys[0][slot] == first) & (keys[1][slot] == second)))
        if len(rest):
            place[rest] = self._distinct(part, starts[rest], ends[rest])
            rest = rest[short[rest]]
            taken, at = np.unique(slot[rest], return_index=True)
            one = rest[at]
            keys[0][taken], keys[1][taken], known[taken] = first[one], second[one], place[one]
        return place

    def find(self, part: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places and counts of the words in the texts of a window, in order."""
        starts, ends = self.split(part, offsets) if part else (np.zeros(0, np.int64),) * 2
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        pairs = row * self.dims + self._places(part, starts, ends)
        pairs, counts = np.unique(pairs.astype(np.int32) if len(offsets) * self.dims < 1 << 31 else pairs, return_counts=True)
        return *np.divmod(pairs.astype(np.int64), self.dims), counts

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places and counts of the words of a column, in order."""
        data, offsets = flat(texts)
        found = [(np.zeros(0, np.int64),) * 3]
        for low, high in windows(offsets, self.BYTES):
            row, place, count = self.find(data[offsets[low] : offsets[high]].tobytes(), offsets[low : high + 1] - offsets[low])
            found.append((row + low, place, count))
        return tuple(np.concatenate(x) for x in zip(*found))

    def packed(self, texts: pa.Array) -> pa.Array:
        """The places in each text in order, and their counts, as bytes: a fraction of the cost of lists on the way to and from Spark.
        A count is one byte; from ``MANY`` on that byte is ``MANY`` and the count follows in ``many``."""
        row, place, count = self.counted(texts)
        at, many = np.searchsorted(row, np.arange(len(texts) + 1)), np.flatnonzero(count >= MANY)
        parts = [
            _bytes(place, at, place_kind(self.dims)), _bytes(np.minimum(count, MANY), at, np.dtype("u1")),
            _bytes(count[many], np.searchsorted(many, at), np.dtype("<i4")),
        ]
        return pa.StructArray.from_arrays(parts, ["places", "counts", "many"])

    def __call__(self, texts: pa.Array) -> pa.Array:
        """A sparse vector of counts for each text, as Spark stores them."""
        row, place, count = self.counted(texts)
        at = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
        columns = {
            "type": pa.array(np.zeros(len(texts), np.int8)),
            "size": pa.array(np.full(len(texts), self.dims, np.int32)),
            "indices": pa.ListArray.from_arrays(at, pa.array(place.astype(np.int32))),
            "values": pa.ListArray.from_arrays(at, pa.array(count.astype(float))),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def word_counts(dims: int, letters: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """How many words of each text have each place."""
    places = WordPlaces(dims, letters)

    def count(texts: pa.Array) -> pa.Array:
        return places(texts)

    return count


def packed_words(dims: int, letters: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """The places in each text and their counts, packed."""
    places = WordPlaces(dims, letters)

    def pack(texts: pa.Array) -> pa.Array:
        return places.packed(texts)

    return pack


def place_kind(dims: int) -> np.dtype:
    """How packed places below ``dims`` are stored."""
    return np.dtype("<u2" if dims <= 1 << 16 else "<i4")


def unpacked(packed: pa.StructArray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and counts of packed words."""
    (places, _), (counts, at), (many, _) = (_flat_bytes(packed.field(name)) for name in ("places", "counts", "many"))
    counts = counts.astype(np.int64)
    if len(many):
        counts[counts == MANY] = many.view("<i4")
    return np.repeat(np.arange(len(packed)), np.diff(at)), places.view(place_kind(dims)).astype(np.int64), counts


def _bytes(values: np.ndarray, at: np.ndarray, kind: np.dtype) -> pa.Array:
    offsets = pa.py_buffer((at * kind.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(values.astype(kind))])


def _flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its n + 1 offsets."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _size(lead: np.ndarray) -> np.ndarray:
    """Bytes of the characters that start with these bytes."""
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
