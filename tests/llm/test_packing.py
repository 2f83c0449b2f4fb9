import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from reviewmill.llm import packing, tokens
from tests.llm import frames

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected_pieces(rows):
    tokenizer = Tokenizer.from_file(PATH)
    found = []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (low, high) in enumerate(zip(cuts, cuts[1:])):
            found.append((key, piece, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())))
    return sorted(found, key=repr)


def check_layout(rows, capacity):
    bins = {}
    for row in rows:
        bins.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_messy_rows(spark):
    rows = packing.pack(packing.cut(frames.documents(spark), PATH)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == expected_pieces(frames.TEXTS)
    assert check_layout(rows, 2048) == -(-sum(r.length for r in rows) // 2048)


def test_empty_table(spark):
    assert packing.pack(packing.cut(frames.empty(spark), PATH)).collect() == []


def test_many_slices_and_a_frequent_length(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, 7 if i % 3 == 0 else rng.randint(1, 64), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, f"doc_id long, {packing.PIECES}")
    got = packing.pack(pieces, capacity=64, slice_rows=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert check_layout(got, 64) <= -(-sum(r.length for r in got) // 64) + 40


def test_fullest_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 40)
        chosen = packing.fullest(counts, room)
        best = max(
            (s for n in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(k * x for k, x in zip(n, counts))) <= room),
            default=0,
        )
        assert sum(x * n for x, n in chosen) == best and all(n <= counts[x] for x, n in chosen)


def test_plan_uses_every_piece_once():
    histogram = {5: 10, 9: 3, 16: 4, 2: 1}
    rows = packing.plan_bins(histogram, 16)
    for length, n in histogram.items():
        places = sorted(p for x, first, last, *_ in rows if x == length for p in range(first, last + 1))
        assert places == list(range(n))


def test_ids_equal_the_library():
    mine, theirs = tokens.ByteLevel(PATH), Tokenizer.from_file(PATH)
    for text in ["", "a  b\n\n c ", "<|endoftext|>x<|endoftext|>", "I'll we've 12½ é日本 \x00\x85", "x" * 3000]:
        assert mine(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space(monkeypatch):
    mine, theirs = tokens.ByteLevel(PATH), Tokenizer.from_file(PATH)
    for text in [f"{a}{space * 2_000_000}{b}" for space in " \n" for a, b in [("a ", "word"), ("a", ""), ("", "'s"), ("x", "<|endoftext|>y")]]:
        assert mine(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "LONG_RUN", 64)
    rng = random.Random(6)
    for _ in range(200):
        runs = [rng.choice(["a", "'s", "12", "!", "\x1c", "日", "<|endoftext|>"]) + "".join(rng.choices(" \n\t\x85\u3000", k=rng.choice([0, 1, 2, 64, 65, 66, 150]))) for _ in range(4)]
        text = "".join(runs)[rng.randint(0, 1) :]
        assert mine(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_every_token_encodes_to_itself():
    vocabulary, _ = tokens.read_vocabulary(PATH)
    model = Tokenizer.from_file(PATH).model
    assert all([x.id for x in model.tokenize(t)] == [i] for t, i in vocabulary.items())
