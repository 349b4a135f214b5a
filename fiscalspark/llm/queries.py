"""Registered queries of the training-data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscalspark.llm.scratch import with_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = with_package(function)
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm.content_sort import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


SQL["op9_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, text_sha256
FROM d
"""


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op7_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k,
         unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM dw),
h AS (SELECT dg.doc_id, dg.i, dg.k, bw.item_id FROM dg JOIN bw ON dg.gram = bw.gram AND dg.k = bw.k),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS word FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from fiscalspark.llm.byte_bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from fiscalspark.llm import scratch, token_store

    docs, folder = table(spark, sf_dir, "documents"), scratch.new_folder(spark, "ids")
    shards = token_store.write(docs, folder, P.path("byte_bpe_50k.json"), P.PATTERN)
    scratch.delete_at_end(spark, folder)
    read = token_store.read(spark, shards, docs.schema["doc_id"].dataType.simpleString())
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm import scratch, warc

    pages, folder = table(spark, sf_dir, "pages"), scratch.new_folder(spark, "warc")
    records = warc.read(spark, warc.write(pages, folder))
    scratch.delete_at_end(spark, folder)
    return records.select(
        F.col("record_id").cast("bigint").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), "stated_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "stated_digest").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


SQL["op3_warc_bundles"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


@query
def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations with the same opening, and each conversation against itself with an echo for an answer."""
    from fiscalspark.llm import preference as P, scratch

    convs = scratch.keep(P.conversations(table(spark, sf_dir, "conversations")), "conversations")
    pairs = P.pair_by_opening(convs).unionByName(P.pair_with_echo(convs))

    def shown(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["s"], x["e"])), ",")

    return P.format_pairs(pairs).select(
        "chosen_id", "rejected_id", "n_common", F.sha2("prompt", 256).alias("prompt_sha256"), "chosen", "rejected",
        shown("chosen_spans").alias("chosen_spans"), shown("rejected_spans").alias("rejected_spans"))


SQL["op2_preference_format"] = r"""
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id),
o AS (
  SELECT *, min(conv_id) OVER (PARTITION BY turns[1]) AS first_id,
         first_value(turns) OVER (PARTITION BY turns[1] ORDER BY conv_id) AS first_turns
  FROM c WHERE conv_id IS NOT NULL),
a AS (
  SELECT *, len(turns) - list_position(list_reverse(list_transform(turns, lambda t: t.role = 'assistant')), true) + 1 AS pos
  FROM c),
pairs AS (
  SELECT first_id AS chosen_id, conv_id AS rejected_id, first_turns AS a, turns AS b FROM o WHERE conv_id <> first_id
  UNION ALL
  SELECT conv_id, conv_id, turns,
         CASE WHEN pos IS NULL THEN turns ELSE list_concat(turns[1:pos - 1],
              [{'role': 'assistant', 'text': CASE WHEN pos > 1 THEN turns[pos - 1].text ELSE '' END}]) END
  FROM a),
n AS (
  SELECT *, (SELECT count(*) FROM range(1, least(len(a), len(b)) + 1) r(i)
             WHERE array_to_string(list_transform(a[1:i], lambda t: t.role || chr(1) || t.text), chr(2))
                 = array_to_string(list_transform(b[1:i], lambda t: t.role || chr(1) || t.text), chr(2))) AS n_common
  FROM pairs),
s AS (
  SELECT chosen_id, rejected_id, n_common,
         list_transform(a, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS pa, a[n_common + 1:] AS ra,
         list_transform(b, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS pb, b[n_common + 1:] AS rb
  FROM n)
SELECT chosen_id, rejected_id, n_common, sha256(coalesce(array_to_string(pa[1:n_common], ''), '')) AS prompt_sha256,
       coalesce(array_to_string(pa[n_common + 1:], ''), '') AS chosen,
       coalesce(array_to_string(pb[n_common + 1:], ''), '') AS rejected,
       coalesce(array_to_string(list_filter(list_transform(ra, lambda t, i: CASE WHEN t.role = 'assistant' THEN
         (coalesce(list_sum(list_transform(pa[n_common + 1:n_common + i - 1], lambda p: len(p))), 0) + 22)::BIGINT || ':' ||
         (list_sum(list_transform(pa[n_common + 1:n_common + i], lambda p: len(p))) - 1)::BIGINT END), lambda x: x IS NOT NULL), ','), '') AS chosen_spans,
       coalesce(array_to_string(list_filter(list_transform(rb, lambda t, i: CASE WHEN t.role = 'assistant' THEN
         (coalesce(list_sum(list_transform(pb[n_common + 1:n_common + i - 1], lambda p: len(p))), 0) + 22)::BIGINT || ':' ||
         (list_sum(list_transform(pb[n_common + 1:n_common + i], lambda p: len(p))) - 1)::BIGINT END), lambda x: x IS NOT NULL), ','), '') AS rejected_spans
FROM s
"""


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm import toxicity
    from fiscalspark.llm.samples import held_out

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm import quality
    from fiscalspark.llm.samples import held_out

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


SQL["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_importance_resampling"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bits AS (
  SELECT c.i AS byte, list_reduce(range(0, 9), lambda x, y: CASE WHEN y = 0 THEN x WHEN x & 1 = 1
         THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, c.i::BIGINT) AS value FROM range(256) c(i)),
crc AS (SELECT list(value ORDER BY byte) AS t FROM bits),
docs AS (SELECT row_number() OVER () AS r, doc_id, w FROM words),
spots AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM docs),
aims AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM target),
every AS (SELECT DISTINCT feature FROM (SELECT feature FROM spots UNION ALL SELECT feature FROM aims)),
hexed AS (SELECT feature, hex(encode(feature)) AS h FROM every),
digits AS (
  SELECT feature, list_transform(range(1, len(h), 2), lambda i: ((instr('0123456789ABCDEF', h[i]) - 1) * 16
         + instr('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT) AS bytes FROM hexed),
bucketed AS (
  SELECT feature, xor(list_reduce(list_concat([4294967295::BIGINT], bytes),
         lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM digits, crc),
s AS (SELECT bucket, count(*) AS s FROM spots JOIN bucketed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN bucketed USING (feature) GROUP BY bucket),
totals AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000)))) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (
  SELECT r, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight
  FROM spots JOIN bucketed USING (feature) JOIN gain USING (bucket) GROUP BY r),
hashed AS (SELECT docs.*, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM docs),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_concat([0::BIGINT], list_transform(range(1, 9),
           lambda i: (instr('0123456789abcdef', h[i]) - 1)::BIGINT)), lambda x, y: x * 16 + y) + 0.5) / 4294967296))))::BIGINT AS score
  FROM hashed LEFT JOIN sums USING (r)),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm import prefix_trie as P, scratch

    lists = scratch.keep(P.turn_lists(table(spark, sf_dir, "conversations")), "turn-lists")
    return P.prefix_trie(P.rebuilt(lists))


SQL["op12_prefix_trie"] = r"""
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (
  SELECT c.i AS byte, list_reduce(range(0, 9), lambda x, y: CASE WHEN y = 0 THEN x WHEN x & 1 = 1
         THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, c.i::BIGINT) AS value FROM range(256) c(i)),
crc AS (SELECT list(value ORDER BY byte) AS crc_table FROM bits),
h AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''),
         lambda x: ascii(x)::BIGINT)), lambda x, y: xor(x >> 8, crc_table[xor(x & 255, y) + 1])), 4294967295) % 6 AS h
  FROM c, crc),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1:h.h], c.t[1:0]), c.t[h.h + 1:]) AS t
  FROM c JOIN h ON h.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, len(t) AS n, unnest(range(0, len(t) + 1)) AS d, t FROM r),
nodes AS (
  SELECT d, t[1:d] AS path, min(conv_id) AS low, count(*) AS n, sha256(coalesce(string_agg(
         conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM p GROUP BY d, t[1:d]),
child AS (
  SELECT k.d, k.path, a.low AS parent_low FROM nodes k JOIN nodes a ON a.d = k.d - 1 AND a.path = k.path[1:k.d - 1]),
kids AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM child GROUP BY 1, 2),
own AS (
  SELECT nodes.d, nodes.path, kids.n IS NULL AS leaf, (nodes.n - 1) * CASE WHEN nodes.d > 0 THEN length(path[nodes.d].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids USING (d, path)),
below AS (
  SELECT k AS d, path[1:k] AS path, sum(leaf::INT)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own) GROUP BY 1, 2)
SELECT nodes.low AS conv_id, nodes.d AS depth, child.parent_low AS parent_conv_id, nodes.n AS n_convs,
       coalesce(kids.n, 0) AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN below USING (d, path) LEFT JOIN kids USING (d, path) LEFT JOIN child USING (d, path)
"""


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalspark.llm.recompression import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op11_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM g),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h WHERE h IN (SELECT h FROM again)),
lost AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
k AS (
  SELECT doc_id, w, coalesce(gone, []) AS gone,
         list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept
  FROM d LEFT JOIN lost USING (r))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE kept END, ' ')) AS kept_sha256
FROM k
"""
