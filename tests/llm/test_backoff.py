import math
from collections import Counter

import pytest

from reviewmill.llm import backoff
from tests.llm import frames


def brute(rows, order=3, alpha=0.4):
    split = [[w.lower() for w in (text or "").split()] for _, text in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in split]
    every, total = sum(grams, Counter()), sum(map(len, split))
    found = []
    for (key, _), words, own in zip(rows, split, grams):
        others = max(total - len(words), 1)

        def score(gram):
            seen = every[gram] - own[gram]
            if len(gram) == 1:
                return seen / others if seen else alpha / others
            return seen / (every[gram[:-1]] - own[gram[:-1]]) if seen else alpha * score(gram[1:])

        logs = [math.log(score(tuple(words[max(0, i - order + 1) : i + 1]))) for i in range(len(words))]
        found.append((key, len(words), sum(logs)))
    return found


@pytest.mark.parametrize("options", [{}, {"block_bytes": 120, "range_bytes": 40}, {"order": 1}, {"order": 2, "backoff": 0.3}])
def test_equals_counting(spark, options):
    rows = [(key, text if key != 5 else "a long text " * 40) for key, text in frames.TEXTS]
    rows += [(20 + i, f"the quick brown dog {i % 3} jumps over the fox") for i in range(12)]
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in backoff.backoff_scores(frames.documents(spark, rows), **options).collect()), key=repr)
    wanted = sorted(brute(rows, options.get("order", 3), options.get("backoff", 0.4)), key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in wanted]
    by_size = lambda x: sorted((k is None, k, n, round(s, 6)) for k, n, s in x)
    assert [r[:3] for r in by_size(got)] == [r[:3] for r in by_size(wanted)]
    assert [r[3] for r in by_size(got)] == pytest.approx([r[3] for r in by_size(wanted)], abs=1e-5)


def test_no_words_and_empty_tables(spark):
    got = frames.by_id(backoff.backoff_scores(frames.documents(spark, [(1, None), (2, ""), (3, " ")])))
    assert all(r[0]["n_words"] == 0 and r[0]["log_score"] == 0 and r[0]["mean_log_score"] is None for r in got.values())
    assert backoff.backoff_scores(frames.empty(spark)).collect() == []


def test_words_with_equal_starts_of_their_hashes(spark):
    import numpy as np

    from reviewmill.llm.texts import Tokens, grams, whitespace_kinds

    words = [f"w{i}" for i in range(300_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts = grams(Tokens(whitespace_kinds(), lower=True)(data, np.array([0, len(data)]))[0], 1, 1) >> np.uint64(32)
    order = np.argsort(starts, kind="stable")
    at = np.flatnonzero(np.diff(starts[order]) == 0)[0]
    rows = [(i, words[order[at + i]]) for i in range(2)]
    got = backoff.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.log_score for r in got] == pytest.approx([math.log(0.4)] * 2)


def test_squeeze_round_trip():
    import numpy as np

    for values in (np.array([], np.uint64), np.array([1, 2**63, 5], np.uint64), np.array([7], np.uint64)):
        assert (backoff.unsqueeze(backoff.squeeze(values), np.uint64) == values).all()
