"""The queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import (
    context_mixing, conversation_trie, decontam, langid, licenses, linededup, mixing, packing, quality_rules, rule_ensemble, secrets, simhash,
    vector_codes,
)
from retentia.llm.base import ASCII_LOWER, ASCII_UPPER, ORACLES, QUERIES, Query, id_remainder, query, table
from retentia.session import scratch_dir

TOKENIZER, VOCABULARY, END_ID = "word_bpe_49k.json", 49_408, 2


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.assess(docs, trusted)


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", id_remainder("doc_id", 5) == 0)
    found = langid.identify(docs.select("doc_id", "text", "held_out"), docs.where("NOT held_out"), key="doc_id")
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = packing.word_encoder(public_tokenizers.path(TOKENIZER), END_ID)
    return packing.read(packing.write(docs, scratch_dir(spark, "tokens"), encoder, VOCABULARY))


DECONTAM_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(t), 13) AS size, array_to_string(t[i : i + 12], ' ') AS win
  FROM (SELECT item, t, unnest(range(1, greatest(len(t) - 11, 2))) AS i FROM b WHERE len(t) > 0)),
dw AS (
  SELECT r, i, size, array_to_string(t[i : i + size - 1], ' ') AS win
  FROM (SELECT r, t, size, unnest(range(1, len(t) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) AS s WHERE len(t) >= size)),
occ AS (SELECT DISTINCT r, i, size, win FROM dw SEMI JOIN bw USING (win, size)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM occ) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM occ JOIN bw USING (win, size) WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""


@query(DECONTAM_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.drop("text_hash")


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(id_remainder("doc_id", 4) != 2)
    scored = rule_ensemble.score(docs, rule_ensemble.fit(docs, labels))
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query()
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder("doc_id", 7) != 2).alias("train"))
    scored = context_mixing.score(docs, "train")
    return scored.withColumn("held_out", ~F.col("train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


@query()
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a tree: a folder per ten, in folders per thousand, by source.

    The first document of each folder of ten is its licence file.
    """
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = [F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 10).cast("string")]
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", *folder, name).alias("path"), "text")
    found = licenses.scan(files)
    return licenses.inherit(files.drop("text"), found)


TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT r, doc_id, i, [trim(x, {TRIM}) FOR x IN l[i : i + 2]] AS win
  FROM (SELECT r, doc_id, l, unnest(range(1, greatest(len(l) - 1, 2))) AS i FROM d)),
later AS (
  SELECT r, i FROM (
    SELECT r, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w
    WHERE array_to_string(win, '') <> '') WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 3)) AS i FROM later),
kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM (SELECT r, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l) - coalesce(kept.n, 0), 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query(LINE_DEDUP_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))

@query()
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts, and digests of the spans; ``n_novel`` counts those the compressor finds."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def _vector_codes_sql() -> str:
    """Squared distances of all parts to all entries, in each round and at the end."""
    near = """
a{n} AS MATERIALIZED (
  SELECT r, pos, any_value(part) AS part, min(d) % 64 AS e, min(d) // 64 AS far
  FROM (SELECT r, p.pos, p.part, 64 * list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.part, c.part)]) + e AS d
        FROM p JOIN c{n} AS c ON p.pos = c.pos)
  GROUP BY r, pos)"""
    moved = """
c{n} AS MATERIALIZED (
  SELECT c.pos, c.e, coalesce(m.part, c.part) AS part FROM c{b} AS c LEFT JOIN (
    SELECT pos, e, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS part
    FROM (SELECT pos, e, j, sum(part[j]) AS total, count(*) AS n
          FROM (SELECT pos, e, part, unnest(range(1, len(part) + 1)) AS j FROM a{b}) GROUP BY pos, e, j)
    GROUP BY pos, e) AS m ON c.pos = m.pos AND c.e = m.e)"""
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v
  FROM (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(embedding) % 16 = 0
          AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding))),
w AS (SELECT len(v) // 16 AS w FROM k WHERE r = 0),
p AS MATERIALIZED (
  SELECT r, pos, v[pos * w + 1 : pos * w + w] AS part
  FROM (SELECT r, v, w, unnest(range(16)) AS pos FROM k, w WHERE len(v) = 16 * w)),
s AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS e FROM (SELECT DISTINCT r FROM p)),
c0 AS MATERIALIZED (SELECT pos, e, part FROM p JOIN s USING (r) WHERE e < 64),{near.format(n=0)},{moved.format(n=1, b=0)},{near.format(n=1)},{moved.format(n=2, b=1)},{near.format(n=2)},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN o USING (r), h
"""


@query(_vector_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries each, two rounds."""
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.drop("label")


# CRC-32 of the decimal digits of an id, a bit at a time.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST({id} AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list(t ORDER BY turn NULLS FIRST, md5(CAST(length(t.role) AS VARCHAR) || ':' || t.role || t.text)) AS l FROM t GROUP BY c),
cut AS (SELECT c, l, CASE WHEN c % 5 = 0 THEN 0 ELSE {CRC_SQL.format(id='c')} % 9 END AS h FROM own),
conv AS MATERIALIZED (
  SELECT cut.c, list_concat(coalesce(b.l, [])[1 : h], cut.l[h + 1 :]) AS l FROM cut LEFT JOIN own AS b ON b.c = cut.c - cut.c % 5),
member AS MATERIALIZED (SELECT c, l, l[1 : d] AS p, d FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM conv)),
node AS MATERIALIZED (
  SELECT p, d, min(c) AS least, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(p[d].text)) END AS saved,
         string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d) AS ends
  FROM member GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
every AS MATERIALIZED (
  SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON node.p = kids.p AND node.d = len(kids.p)),
sub AS (
  SELECT p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p[1 : u] AS p, leaf, saved FROM (
    SELECT p, (n_children = 0)::INT AS leaf, saved, unnest(range(d + 1)) AS u FROM every)) GROUP BY p)
SELECT e.least AS conv_id, CAST(e.d AS BIGINT) AS depth, f.least AS parent_conv_id, CAST(e.n AS BIGINT) AS n_convs,
       CAST(e.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM every AS e JOIN sub ON e.p = sub.p LEFT JOIN every AS f ON e.d > 0 AND f.d = e.d - 1 AND f.p = e.p[1 : e.d - 1]
"""


@query(TRIE_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
