"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from termbridge.llm import (
    bloom_lm,
    byte_bpe,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    language,
    licenses,
    line_dedup,
    minhash,
    mixing,
    periods,
    url_filter,
    warc,
)
from termbridge.session import scratch_path

col = F.col
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(col("doc_id").cast("string").cast("binary")) % n


def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark, sf_dir):
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents.where(fold(3) != 1))
    found = language.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "bits", "accepted")


def op5_license_scan(spark, sf_dir):
    return licenses.find_licences(table(spark, sf_dir, "documents"))


def op6_bloom_lm(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(7) != 2).alias("train"))
    return bloom_lm.score_texts(documents, "train")


def op7_byte_bpe(spark, sf_dir):
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_ids(encoded, RANKS)
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_hard_negatives(spark, sf_dir):
    shifted = F.when(col("vec_id") % 7 == 0, (col("label").cast("long") + 1) % 10).otherwise(col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), col("vec_id") % 100 == 0, label=shifted)


def planted_periods(words):
    """The words of a text; by the crc32 of doc_id, every tenth text repeats a stretch of them to its end."""
    n = F.size(words).cast("long")
    h = F.crc32(col("doc_id").cast("string").cast("binary"))
    g = F.expr("crc32(cast(cast(doc_id AS STRING) AS BINARY)) div 10")

    def repeat(a):
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.concat(F.slice(words, F.lit(1), a.cast("int")), tail)

    return F.when((h % 10 == 0) & (n > 0), repeat(g % n)).otherwise(words)


def op12_periodic_runs(spark, sf_dir):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({_WORD})"), F.lit(1))
    texts = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    texts = texts.select("doc_id", F.array_join(planted_periods(col("words")), " ").alias("text"))
    found = periods.periodic_runs(texts)
    # Exact length / period: cross products order the runs; the earlier (start, period) stays when they tie.
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    back = warc.read_archives(spark, path, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_line_dedup,
        op3_minhash,
        op4_language_id,
        op5_license_scan,
        op6_bloom_lm,
        op7_byte_bpe,
        op8_exact_dedup,
        op9_mixing,
        op10_url_filter,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_warc,
    )
}

SQL = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(first, doc_id) = doc_id AS stays FROM keyed k LEFT JOIN firsts USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op5_license_scan": licenses.SQL,
    "op8_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS n FROM texts)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped""",
    "op11_hard_negatives": r"""
WITH given AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM given a JOIN given b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
    "op13_warc": r"""
WITH given AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM given)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM firsts""",
}
