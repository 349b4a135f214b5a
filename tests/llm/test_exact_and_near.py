import hashlib
import random
import re
from collections import defaultdict

import pytest

from fiscalspark.llm import content_sort, ngram_join as J
from fiscalspark.llm.components import components
from tests.llm import cases


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, best, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_exact_groups_match_a_plain_grouping(spark, ranges):
    docs = cases.documents(spark)
    expected = exact_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert cases.rows_of(content_sort.exact_groups(docs, ranges=ranges)) == expected


def test_exact_groups_of_many_copies_over_many_ranges(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('text ', id % 700)) as text")
    expected = exact_by_hand([tuple(r) for r in docs.collect()])
    assert cases.rows_of(content_sort.exact_groups(docs, ranges=50)) == expected


def test_exact_groups_of_an_empty_table(spark):
    assert content_sort.exact_groups(cases.documents(spark).where("false")).collect() == []


def sets_by_hand(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_by_hand(rows):
    sets = [sets_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), best.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates_of_awkward_rows(spark):
    docs = cases.documents(spark)
    assert cases.rows_of(J.near_duplicates(docs)) == near_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def variants(seed, groups, members, words, changes):
    """Texts that differ from a common one by up to so many words, many at the border of the similarity."""
    rng = random.Random(seed)
    rows, n = [], 0
    common = " ".join(f"passage{i}" for i in range(30))
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, changes)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 5)}"
            if rng.random() < 0.3:
                text += common.split()
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,groups,members,words,changes", [(1, 12, 12, 60, 4), (2, 3, 60, 120, 8), (3, 30, 4, 12, 2)])
def test_near_duplicates_match_all_pairs(spark, seed, groups, members, words, changes):
    rows = variants(seed, groups, members, words, changes)
    assert cases.rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == near_by_hand(rows)


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    rows = variants(4, 2, 60, 80, 6)
    assert cases.rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == near_by_hand(rows)


def test_near_duplicates_of_an_empty_table(spark):
    assert J.near_duplicates(cases.documents(spark).where("false")).collect() == []


def test_size_bounds_hold_for_all_small_sizes():
    for n in range(1, 400):
        for m in range(-(-n * 4 // 5), n + 1):
            least = next((i for i in range(m + 1) if 100 * i >= 80 * (n + m - i)), None)
            if least is not None:
                assert n - least <= J.misses(n) and m - least <= J.misses(m)
                in_both = min(J.extra(n) if J.misses(n) + J.extra(n) < n else least, J.extra(m) if J.misses(m) + J.extra(m) < m else least)
                assert min(in_both, least) >= max(min(J.needed(n), least), 1) or J.needed(n) == 1
                assert J.needed(n) <= max(1, min(in_both, least)) and J.needed(m) <= max(1, min(in_both, least))


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                root.setdefault(x, x)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    expected = []
    for x in root:
        r = x
        while root[r] != r:
            r = root[r]
        expected.append((x, r))
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert cases.rows_of(got) == sorted(expected, key=repr)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
