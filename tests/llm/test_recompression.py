import random
import re
from collections import Counter

import numpy as np
import pytest

from fiscalspark.llm import recompression as R, words as W
from tests.llm import cases


def by_hand(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in df.collect()), key=repr)


def texts(seed, n, vocabulary, size):
    """Texts with copied passages of many lengths, runs of one word and periodic parts, over a small vocabulary."""
    rng = random.Random(seed)
    pool = [[f"p{i}w{rng.randrange(vocabulary)}" for _ in range(rng.randint(3, 60))] for i in range(6)]
    rows = []
    for i in range(n):
        words = []
        while len(words) < rng.randint(0, size):
            kind = rng.random()
            if kind < 0.3:
                passage = rng.choice(pool)
                a = rng.randrange(len(passage))
                words += passage[a:a + rng.randint(1, 60)]
            elif kind < 0.4:
                words += [f"run{rng.randint(0, 1)}"] * rng.randint(1, 50)
            elif kind < 0.5:
                words += ["tick", "tack", "tock"][:rng.randint(2, 3)] * rng.randint(1, 20)
            else:
                words += [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,n,vocabulary,size,window", [(1, 60, 50, 200, 35), (2, 200, 3, 120, 35), (3, 80, 2, 60, 5), (4, 40, 1, 90, 12),
                                                           (5, 30, 400, 600, 63)])
def test_removed_words_match_a_plain_search(spark, seed, n, vocabulary, size, window):
    rows = texts(seed, n, vocabulary, size)
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string").repartition(5 if seed % 2 else 31)
    assert found(R.without_repeats(docs, window=window)) == by_hand(rows + rows[:3], window)


@pytest.mark.parametrize("window", [35, 4])
def test_awkward_rows(spark, window):
    docs = cases.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(R.without_repeats(docs, window=window)) == by_hand(rows, window)
    assert R.without_repeats(docs.where("false")).collect() == []


def test_equal_windows_have_equal_anchors_at_equal_places():
    rng = random.Random(8)
    passage = [f"v{rng.randrange(9)}" for _ in range(80)]
    sides = [[f"s{rng.randrange(9)}" for _ in range(rng.randint(0, 40))] + passage[:40] for _ in range(20)]
    bodies = [" ".join(s + passage + s[::-1]).encode() for s in sides]
    words = W.split(bodies, R._PLAIN)
    first, name, level, place, _ = R.anchors(words)
    known = {}
    for i, a in enumerate(first.tolist()):
        content = tuple(words.text(j) for j in range(a, a + R.WINDOW))
        assert known.setdefault(content, (name[i], level[i], place[i] - a)) == (name[i], level[i], place[i] - a)
    text, start, n, longer = R.units(words)
    known = {}
    for i in np.repeat(np.arange(len(n)), n).tolist():
        for k in range(n[i]):
            content = tuple(words.text(j) for j in range(start[i] + k, start[i] + k + R.WINDOW))
            assert known.setdefault(content, longer[i]) == longer[i]
    assert n.sum() == len(first) and n.max() <= R.WINDOW and len(n) < len(first) / 4
    assert np.all(np.diff(text) >= 0)


def test_rounds_shrink_any_text():
    for body in (b"a " * 999, b"a b " * 500, b" ".join(b"w%d" % (i * i % 97) for i in range(999))):
        names = W.split([body], R._PLAIN).hashes
        docs = np.zeros(len(names), np.int64)
        for number in range(40):
            if number % R.RUNS_EVERY == 0:
                names, index = R.run_round(names, docs)
            else:
                names, index, _ = R.pair_round(names, docs, number)
            docs = np.zeros(len(names), np.int64)
        assert len(names) < 12
