import numpy as np
import pyarrow as pa

from reviewmill.llm import texts


def test_tokens_match_split():
    rows = ["a b  c", None, "", " x\ty\n", "ab\xe9 b", "z" * 5000]
    data, offsets = texts.flat(pa.array(rows).slice(0))
    tokens = texts.Tokens(texts.whitespace_kinds())
    starts, ends, first = tokens.split(data, offsets)
    words = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
    assert words == [w for r in rows for w in (r or "").split()]
    assert np.diff(first).tolist() == [len((r or "").split()) for r in rows]


def test_hashes_depend_on_bytes_only(monkeypatch):
    rows = [f"w{i % 7} Same {i}" for i in range(500)]
    data, offsets = texts.flat(pa.array(rows))
    whole = texts.Tokens(texts.whitespace_kinds(), lower=True)(data, offsets)[0]
    monkeypatch.setattr(texts, "WINDOW", 16)
    assert (texts.Tokens(texts.whitespace_kinds(), lower=True)(data, offsets)[0] == whole).all()
    words = [w.lower() for r in rows for w in r.split()]
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(words, whole.tolist()))
    assert len(set(known.values())) == len(known)


def test_slices_ranges_and_grams():
    column = pa.array(["aa", "b", None, "cccc"]).slice(1)
    data, offsets = texts.flat(column)
    assert bytes(data) == b"bcccc" and offsets.tolist() == [0, 1, 1, 5]
    assert list(texts.ranges(offsets, 2)) == [(0, 2), (2, 3)]
    words = np.arange(5, dtype=np.uint64)
    assert len(texts.grams(words, 2, 2)) == 4 and len(texts.grams(words, 6, 6)) == 0
    assert (texts.grams(words, 2, 2)[1:3] == texts.grams(words[1:4], 2, 2)).all()
