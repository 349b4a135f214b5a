import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fiscalspark.llm import toxicity
from tests.compare import connect, differences
from tests.llm.test_exact_and_near import near_by_hand
from tests.llm.test_models_and_benchmark import report_by_hand

P = pytest.importorskip("public_tokenizers")
SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder):
    """Documents with toxic words, copies, near copies and a benchmark passage."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(15, 60))) for _ in range(240)]
    items = [(i, " ".join(f"q{rng.randint(0, 500)}" for _ in range(20))) for i in range(5)]
    labels = []
    for i in range(0, 240, 3):
        texts[i] = " ".join("vile" if k % 6 == 3 else w for k, w in enumerate(texts[i].split()))
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(1, 240, 3)]
    texts += [texts[1].replace(" ", "  "), texts[2], texts[4] + " more", texts[7] + " " + items[0][1], None, "", " \n"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1)]
    for name, rows, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id bigint, quality int, toxic int"),
                               ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs, items


def test_stages_match_a_plain_pipeline(spark, tmp_path):
    import base64

    import tiktoken

    docs, items = tables(spark, tmp_path)
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["toxicity", "exact dedup"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    model = toxicity.train(kept, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(kept, model).collect()}
    expected = [d for d in docs if scores[d[0]] < toxicity.THRESHOLD]
    assert not [d for d in expected if "vile" in (d[1] or "")] and len(expected) > 150

    def step(stage, wanted):
        nonlocal kept
        got = stage(spark, kept, str(tmp_path))
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=repr) == sorted(((d[0], d[1]) for d in wanted), key=repr)
        got.write.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
        kept = spark.createDataFrame(wanted, COLUMNS)

    step(stages[0], expected)
    best = {}
    for d in sorted(expected, key=lambda d: d[0]):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d[1] or ""), d)
    expected = list(best.values())
    step(stages[1], expected)
    component = {doc_id: c for doc_id, _, c in near_by_hand([(d[0], d[1]) for d in expected])}
    expected = [d for d in expected if component[d[0]] == d[0]]
    step(stages[2], expected)
    bad = {r[0] for r in report_by_hand([(d[0], d[1]) for d in expected], items) if r[4]}
    assert bad
    expected = [d for d in expected if d[0] not in bad]
    step(stages[3], expected)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d[0], len(ids := plain.encode_ordinary(d[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                  for d in expected)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256")
    assert sorted(map(tuple, got.collect())) == want


def test_near_copies_that_share_an_identifier(spark, tmp_path):
    """One row of each component stays, with its own text, also where identifiers repeat or are missing."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(2, a), (5, f"{a} more"), (5, b), (6, c), (6, f"{c} more"), (6, f"{c} more"), (None, f"{d} more"), (None, d),
            (None, "alone without an identifier"), (None, f"{b} more"), (9, None), (9, " "), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    left = [tuple(r) for r in got.select("doc_id", "text").collect()]
    assert got.columns == docs.columns and set(left) <= set(rows)
    sure = [(2, a), (5, b), (None, "alone without an identifier"), (9, None), (9, " "), (None, None), (None, "")]
    others = [r for r in left if r not in sure]
    assert sorted((r for r in left if r in sure), key=repr) == sorted(sure, key=repr)
    assert sorted((i, t.split()[0]) for i, t in others if i) == [(6, "c0")]
    assert [(i, t.split()[0]) for i, t in others if i is None] == [(None, "d0")]


def test_pipeline_of_empty_documents(spark, tmp_path):
    tables(spark, tmp_path / "full")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if re.match(r"op\d+_", n)))
def test_registered_queries(spark, name):
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert differences(spark, connect(SF_DIR), SF_DIR, name, run, sql) is None
        return
    df = run(spark, SF_DIR)
    rows = df.where(F.col(df.columns[0]).isNotNull()).count()
    source = "pages" if name.startswith("op8") else "documents"
    assert rows == spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()


def test_dedup_stages_keep_columns_with_any_name_and_choose_alike(spark):
    rows = [(1, "a b  c", "keep me", 1), (1, "a  b c", "or me", 2), (2, "a b c", "not me", 3), (3, None, "null", 4), (4, "", "blank", 5),
            (5, "x y z x y", "b", 6), (5, "x y z x y", "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, row int")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        seen = []
        for shuffled in (docs, docs.orderBy(F.desc("_text")), docs.repartition(5)):
            got = stage(spark, shuffled, "")
            assert got.columns == docs.columns
            seen.append(sorted(map(tuple, got.collect()), key=repr))
        assert seen[0] == seen[1] == seen[2]
        assert set(seen[0]) <= set(rows) and (5, "x y z x y", "a", 6) in seen[0] and (5, "x y z x y", "b", 6) not in seen[0]
        assert sum(r[0] == 1 for r in seen[0]) == 1 or stage is corpus_pipeline.drop_near_copies
    lone = spark.createDataFrame([(1, "a b"), (1, "a  b")], "doc_id long, text string")
    assert corpus_pipeline.drop_exact_copies(spark, lone, "").count() == 1
