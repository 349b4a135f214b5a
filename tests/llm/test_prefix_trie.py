import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from fiscalspark.llm import prefix_trie as P
from tests.llm import cases

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt_by_hand(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, turns in convs.items():
        h = crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:]
    return out


def nodes_by_hand(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(path))))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, most_turns, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 5 * n), n):
        for t in range(rng.randint(1, most_turns)):
            rows.append((c, t, rng.choice(("user", "assistant")), f"{rng.choice(words)}" * rng.randint(1, 2)))
    return rows


@pytest.fixture(params=[1, 3, 10000])
def batch_size(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed,n,most_turns,words", [(1, 120, 4, ["a", "b"]), (2, 60, 12, ["x"]), (3, 200, 3, [f"w{i}" for i in range(150)])])
def test_nodes_match_a_plain_trie(spark, batch_size, seed, n, most_turns, words):
    rows = conversations(seed, n, most_turns, words)
    rows += [(c, t, "user", "the same") for c in range(9000, 9060) for t in range(7)]  # many copies of one conversation
    lists = P.turn_lists(cases.with_clashes(spark.createDataFrame(rows, SCHEMA)))
    assert cases.rows_of(P.prefix_trie(P.rebuilt(lists))) == nodes_by_hand(rebuilt_by_hand(rows))


def test_awkward_conversations(spark):
    rows = [(7, None, None, None), (7, None, "user", None), (7, 0, "", "x"), (100, 5, "user", "long " * 9000), (100, 5, "user", "long " * 9000),
            (None, 0, "user", "nobody's"), (112, 0, "a", "b"), (113, 0, "ab", ""), (-105, 1, "user", "Ü \U0001f600 日本"), (-100, 3, "u", "first"),
            (2 ** 60, 0, "user", "far")] + [(c, 0, "user", "gone") for c in range(213, 220)]
    lists = P.turn_lists(spark.createDataFrame(rows, SCHEMA))
    expected = rebuilt_by_hand(rows)
    assert [] in expected.values()
    assert cases.rows_of(P.prefix_trie(P.rebuilt(lists))) == nodes_by_hand(expected)
    assert P.prefix_trie(P.turn_lists(spark.createDataFrame([], SCHEMA))).collect() == []


def test_many_members_are_hashed_in_pieces(spark, monkeypatch):
    one = P.Range(0)
    monkeypatch.setattr(P, "PIECE", 8)
    rows = one.block([b"k" * 16] * 9, list(range(9)), [[3]] * 9) + one.block([b"k" * 16] * 5, list(range(10, 15)), [[3]] * 5) + one.end()
    pieces = b"".join(r["ends"] for r in rows if r["kind"] == "piece")
    assert pieces == b"".join(b",%d" % i for i in [*range(9), *range(10, 15)])


@pytest.mark.parametrize("fanout", [3, 4, 5, 16, 17, 48, 49, 256])
def test_node_layouts_grow_and_keep_their_order(fanout):
    tree = P.RadixTree()
    order = list(range(fanout))
    random.Random(fanout).shuffle(order)
    for b in order:
        tree.add(b"same" + bytes([b]) + b"tail", b, [1])
        tree.add(b"same", -b, [1])
    (_, branch), = tree.root.kids.items()
    assert branch.edge == b"same" and len(branch.ends) == fanout
    assert [(b, k.edge, k.ends) for b, k in branch.kids.items()] == [(b, bytes([b]) + b"tail", [b]) for b in range(fanout)]
    kind = type(branch.kids)
    assert kind is (P.Small if fanout <= 16 else P.Indexed if fanout <= 48 else P.Full)
