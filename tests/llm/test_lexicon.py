import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from reviewmill.llm import lexicon, tokens
from tests.llm import frames

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def expected(text):
    tokenizer = library()
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_messy_rows(spark):
    for size in (3, 1000):  # nearly all words merged, nearly all found
        got = frames.by_id(lexicon.encode_digests(frames.documents(spark), PATH, words=size))
        for key, text in frames.TEXTS:
            ids, shown = expected(text)
            wanted = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
            assert wanted in [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got[key]]


def test_empty_table(spark):
    assert lexicon.encode(frames.empty(spark), PATH).collect() == []


def test_random_texts(tmp_path):
    rng = random.Random(3)
    signs = "aAbB'sSt 1²_-!?\n\té日Σ<|>endoftext ́"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    counts = Counter(w for words in tokens.WordSplitter()(texts) for w in words)
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.build([w for w, _ in counts.most_common(300)], PATH).to_bytes())
    encoder, tokenizer = lexicon.Encoder(lexicon.Transducer.mapped(str(path)), PATH), library()
    for text, (ids, shown) in zip(texts, encoder(texts)):
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted
        assert shown == tokenizer.decode(wanted, skip_special_tokens=False)


def test_automaton_is_minimal_and_complete():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    states, ends, start = lexicon.minimal_automaton(words)
    reached, todo = {start}, [start]
    while todo:
        for target in states[todo.pop()].values():
            if target not in reached:
                reached.add(target)
                todo.append(target)
    rests = {frozenset(w[n:] for w in words if w.startswith(p[:n])) for p in words for n in range(len(p) + 1)}
    assert len(reached) == len(rests)  # one state for each set of endings
    compiled = lexicon.Transducer.compile({w: [i, i + 1] for i, w in enumerate(words)})
    others = [b"", b"c", words[0] + b"zz"]
    found = compiled.find(words + others).tolist()
    assert found == list(range(len(words))) + [-1] * 3
    assert compiled.ids_of(5).tolist() == [5, 6]


def test_every_token_is_what_its_bytes_merge_to():
    """By pairs, as the library merges: then merging by the rank of the joined bytes gives the same ids."""
    import json

    with open(PATH, encoding="utf-8") as file:
        merges = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(json.load(file)["model"]["merges"])}
    for token in tokens.read_vocabulary(PATH)[0]:
        signs = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            signs[-1] += "</w>"
        while len(signs) > 1:
            rank, at = min((merges.get(pair, len(merges)), i) for i, pair in enumerate(zip(signs, signs[1:])))
            assert rank < len(merges), token
            signs[at : at + 2] = [signs[at] + signs[at + 1]]


def test_frequent_words_of_all_documents(spark):
    rows = [(i, "common words " + ("rare" if i == 7 else "")) for i in range(30)]
    assert lexicon.frequent_words(frames.documents(spark, rows), "text", 2) in (["common", "words"], ["words", "common"])


def test_words_of_every_code_point():
    """Newer letters too, which the standard library's tables do not have; code points that no table has go in one text."""
    tokenizer, merge = library(), tokens.WordMerger(PATH)
    for low in range(0, 0x110000, 0x1000):
        signs = [chr(c) for c in range(low, low + 0x1000) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b {c}É" for c in signs]
        if 0x40000 <= low < 0xE0000:
            texts = [" ".join(texts[i : i + 256]) for i in range(0, len(texts), 256)]
        split = tokens.WordSplitter()(texts)
        for text, words, wanted in zip(texts, split, tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert [i for w in words for i in merge(w)] == wanted.ids, ascii(text[:9])
