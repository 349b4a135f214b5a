import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalspark.llm import decontaminate as D, quality, toxicity, words as W
from fiscalspark.llm.samples import held_out
from tests.llm import cases


def hidden(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def labelled(spark, toxic_share=0.2, n=900):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < toxic_share, rng.random() < 0.7
        w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 300)}" for _ in range(rng.randint(20, 90))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["nasty", "vile", "awful", f"blargh{rng.randint(0, 99)}"])
        if not good:
            w = [f"{x.upper()}!!" for x in w] if rng.random() < 0.5 else w[:3] * (len(w) // 3)
        docs.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    truth = {i: (bool(g), bool(t)) for i, g, t in labels}
    labels += [(None, 1, 1), (1, None, None), (labels[0][0], *labels[0][1:])]
    return (cases.with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string")),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), truth)


def accuracy(scored, truth, which, threshold):
    got = {r["doc_id"]: r["score"] >= threshold for r in scored.collect()}
    judged = [got[i] == truth[i][which] for i in truth if hidden(i)]
    return sum(judged) / len(judged)


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert accuracy(scored, truth, 1, toxicity.THRESHOLD) > 0.9  # repetition destroys some words
    kept = toxicity.keep_below(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where(f"score < {toxicity.THRESHOLD}").count()
    again = toxicity.train(docs.repartition(5), labels)
    assert np.array_equal(again.names, model.names) and np.allclose(again.weights, model.weights)


def test_quality_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    assert accuracy(quality.score(docs, quality.train(docs, labels)), truth, 0, 0.5) > 0.95


def test_held_out_rule(spark):
    got = spark.range(50).withColumn("x", held_out(F.col("id")))
    assert all(r["x"] == hidden(r["id"]) for r in got.collect())


@pytest.mark.parametrize("keep", ["true", "toxic = 0 and quality = 1", "false"])
def test_models_take_awkward_rows_and_missing_labels(spark, keep):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (8, 0, 0), (10, 1, 0)], "doc_id bigint, quality int, toxic int").where(keep)
    for module in (toxicity, quality):
        scored = module.score(docs, module.train(docs, labels))
        assert scored.count() == docs.count() and scored.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
        assert module.score(docs.where("false"), module.train(docs.where("false"), labels)).collect() == []


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(1)
    p = quality.fit([rng.normal(size=(2, quality.N_FEATURES)) for _ in range(6)], np.array([0., 1, 0, 1, 1, 0])).weights
    x, first, y = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 2, 3, 7]), np.array([1., 0, 1])
    loss = lambda: float(np.sum(np.logaddexp(0, (m := quality.forward(p, x, first)[0])) - y * m))
    margins, held = quality.forward(p, x, first)
    exact = quality.backward(p, x, first, held, toxicity.sigmoid(margins) - y)
    for name, at in (("encode", (3, 2)), ("gate_t", (1, 4)), ("gate_s", (5, 0)), ("attend", (2,)), ("out", (7,)), ("encode_bias", (3,))):
        p[name][at] += 1e-6
        up = loss()
        p[name][at] -= 2e-6
        down = loss()
        p[name][at] += 1e-6
        assert abs((up - down) / 2e-6 - exact[name][at]) < 1e-4


def words_by_hand(text, keep):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if keep(c):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def alnum(c):
    return c.isascii() and c.isalnum() or ord(c) > 127


def report_by_hand(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w = words_by_hand(text, alnum)
        hit, found = set(), set()
        for item, body in items:
            b = words_by_hand(body, alnum)
            size = min(window, len(b))
            grams = {tuple(b[i:i + size]) for i in range(len(b) - size + 1)} if size else set()
            for i in range(len(w) - size + 1 if size else 0):
                if tuple(w[i:i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), len({f for f in found if f is not None}), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def contaminated(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"B{rng.randint(0, 60)}" for _ in range(rng.choice([3, 12, 13, 14, 30])))) for i in range(25)]
    items += [(99, None), (98, "--"), (None, "null item here"), (97, items[0][1])]
    docs = []
    for i in range(60):
        w = [f"b{rng.randint(0, 60)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w += (rng.choice(items)[1] or "").upper().split()
        docs.append((i, "-- ".join(w)))
    docs += [(100, None), (101, ""), (102, f"null ITEM,here {cases.LONG} null item here"), (None, "x"), (7, docs[7][1])]
    return (cases.with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string")), docs,
            spark.createDataFrame(items, "item_id bigint, text string"), items)


def test_contamination_matches_a_plain_scan(spark):
    docs, rows, benchmark, items = contaminated(spark)
    got = D.report(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "contaminated")
    expected = report_by_hand(rows, items)
    assert cases.rows_of(got) == expected
    in_blocks = D.report(docs, benchmark, windows_at_once=60).select("doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert sorted(set(cases.rows_of(in_blocks)), key=repr) == sorted(set(expected), key=repr)
    clean = {r["doc_id"] for r in D.without_documents(docs, benchmark).collect()}
    assert clean == {e[0] for e in expected if not e[4]}


PASSAGE = " ".join(f"b{i}" for i in range(14))
REPEATED = [(None, f"{PASSAGE} end"), (None, "a clean text"), (None, "another clean one"), (None, None), (7, "seven is clean"),
            (7, f"begin {PASSAGE}"), (8, "the same"), (8, "the same"), (9, f"x {PASSAGE} y"), (9, f"x {PASSAGE} y")]


def repeated(spark):
    """Rows that share an identifier (null too) with other texts, or with the same, and a benchmark of several items."""
    items = [(1, PASSAGE)] + [(i, " ".join(f"c{i}x{j}" for j in range(20))) for i in range(2, 8)]
    return (cases.with_clashes(spark.createDataFrame(REPEATED, "doc_id bigint, text string")),
            spark.createDataFrame(items, "item_id bigint, text string"))


@pytest.mark.parametrize("windows_at_once", [D.WINDOWS_AT_ONCE, 40])
def test_clean_rows_stay_whatever_their_identifier(spark, windows_at_once):
    docs, benchmark = repeated(spark)
    left = D.without_documents(docs, benchmark, windows_at_once=windows_at_once)
    assert left.columns == docs.columns
    assert cases.rows_of(left.select("doc_id", "text")) == sorted((r for r in REPEATED if PASSAGE not in (r[1] or "")), key=repr)


def test_blocks_give_the_rows_of_one_scan(spark):
    docs, rows, benchmark, items = contaminated(spark)
    docs = docs.unionByName(docs.where("doc_id < 20"))
    whole = cases.rows_of(D.report(docs, benchmark))
    assert cases.rows_of(D.report(docs, benchmark, windows_at_once=60)) == whole and len(whole) > len(rows)
    counts = [w[:4] + w[5:] for w in whole]
    assert sorted(counts, key=repr) == report_by_hand(rows + [r for r in rows if r[0] is not None and r[0] < 20], items)
    docs, benchmark = repeated(spark)
    hits = [cases.rows_of(D.find_hits(docs, benchmark, windows_at_once=n)) for n in (D.WINDOWS_AT_ONCE, 40)]
    assert hits[0] == hits[1] and len(hits[0]) == len(REPEATED)


def test_spans_are_cut_out(spark):
    docs, rows, benchmark, items = contaminated(spark)
    cut = D.without_spans(docs, benchmark)
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.count() == len(rows) and left[100] is None and left[101] == ""
    expected = {e[0]: e for e in report_by_hand(rows, items)}
    for doc_id, text in left.items():
        assert len(words_by_hand(text, alnum)) <= expected[doc_id][1] - expected[doc_id][2] + 1 or expected[doc_id][2] == 0


@pytest.mark.parametrize("windows_at_once", [D.WINDOWS_AT_ONCE, 40])
def test_spans_are_cut_out_of_their_own_row(spark, windows_at_once):
    docs, benchmark = repeated(spark)
    more = [(7, "b0"), (None, f"a longer start {PASSAGE} and {PASSAGE}")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    expected = [(i, t and t.replace(PASSAGE, "")) for i, t in REPEATED + more]
    assert cases.rows_of(D.without_spans(docs, benchmark, windows_at_once=windows_at_once)) == sorted(expected, key=repr)


def test_contamination_of_empty_tables(spark):
    docs, _, benchmark, _ = contaminated(spark)
    assert D.report(docs.where("false"), benchmark).collect() == []
    assert D.report(docs, benchmark.where("false")).where("n_hit > 0 or contaminated").count() == 0


@pytest.mark.parametrize("table,keep", [(W.BY_ALNUM, alnum), (W.BY_SPACE, lambda c: not (c == " " or 9 <= ord(c) <= 13))])
def test_words_are_split_as_characters_are(table, keep):
    texts = ["", " ", "a", "A b\tC", "x" * 5000, "é,ü;日本 z", "a\x00b \x0bq\x85 r s"]
    w = W.split([t.encode() for t in texts], table)
    got = [[w.text(k).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [words_by_hand(t, keep) for t in texts]
    seen = {}
    for k, h in enumerate(w.hashes.tolist()):
        assert seen.setdefault(h, w.text(k)) == w.text(k)
