import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from fiscalspark.llm import resample as R
from tests.llm import cases


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def buckets_of(text):
    w = words_of(text)
    return [crc32(f.encode()) % R.BUCKETS for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def by_hand(rows, target, least_words=R.LEAST_WORDS, percent=R.PERCENT):
    s, t = [0] * R.BUCKETS, [0] * R.BUCKETS
    for texts, counts in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for b in buckets_of(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + R.BUCKETS) / ((a + 1) * (sum(t) + R.BUCKETS)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(fit[:percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("least_words,percent", [(20, 25), (0, 50), (5, 100), (1, 1)])
def test_awkward_rows(spark, least_words, percent):
    docs = cases.documents(spark)
    target = spark.createDataFrame([("one two three short",), (None,), ("w1x1 w2x2 日本",)], "text string")
    got = R.resample(docs, target, least_words=least_words, percent=percent)
    assert cases.rows_of(got) == by_hand(plain(docs), [r["text"] for r in target.collect()], least_words, percent)


def test_random_texts_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(R, "COPIES_AT_ONCE", 7)
    rng = random.Random(3)
    rows = [(i, " ".join(f"v{rng.randint(0, 90)}" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, "the same text " * 10)] * 150 + [(5, "five again " * 15)] * 60
    docs, target = spark.createDataFrame(rows, "doc_id bigint, text string"), ["v1 v2 v3 v4", "same text the"]
    for percent in (25, 60, 99):
        got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
        assert cases.rows_of(got) == by_hand(rows, target, percent=percent)


@pytest.mark.parametrize("pivots", [1, 2, 31])
def test_kth_key_is_that_of_a_sort(spark, pivots):
    rng = random.Random(pivots)
    rows = [(rng.randint(-5, 5), rng.randint(0, 9), rng.randint(1, 4)) for _ in range(120)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").select(F.struct("a", "b").alias("key"), "c").cache()
    keys = sorted((a, b) for a, b, c in rows for _ in range(c))
    for k in (1, len(keys) // 3, len(keys)):
        border = R.kth_key(df, "key", "c", k, pivots)
        assert border.key == keys[k - 1]
        assert border.taken == k - sum(x < keys[k - 1] for x in keys)


def test_empty_tables_and_text_identifiers(spark):
    docs = cases.documents(spark)
    nothing = docs.where("false")
    assert R.resample(nothing, docs).collect() == []
    assert cases.rows_of(R.resample(docs, nothing)) == by_hand(plain(docs), [])
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    ranks = [r["rank"] for r in R.resample(named, docs, least_words=1).collect() if r["rank"] is not None]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) == sum(bool(words_of(t)) for _, t in plain(docs)) * 25 // 100
