"""Registered queries on vectors and retrieval, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from termbridge.catalog.base import rounded, table
from termbridge.functions import similarity
from termbridge.operators import assign, ranking, retrieval, vectors

from termbridge.plans import mapping
from termbridge.session import spread

col = F.col
K = 10


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", similarity.l2_normalize(col("embedding")).alias("vec"), "label"
    )


def _universe(spark, sf_dir):
    return _vectors(spark, sf_dir).select(col("vec_id").alias("code"), col("vec").alias("embedding"))


def _top(spark, sf_dir, k=K, **search):
    queries = _vectors(spark, sf_dir).select(col("vec_id").alias("query_id"), "vec")
    return retrieval.topk_inner_product(queries, _universe(spark, sf_dir), k, **search)


def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (col("label") + 0.5))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    unit = rows.select("vec_id", F.posexplode(similarity.l2_normalize(col("v"))).alias("pos", "x"))
    return rounded(unit)


def cos_similarity(spark, sf_dir):
    """Every vector with the next one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((col("vec_id") - 1).alias("vec_id"), col("embedding").alias("other"))
    pairs = rows.join(following, "vec_id")
    score = similarity.cos_similarity(col("embedding"), col("other")).alias("cos_similarity")
    return rounded(pairs.select("vec_id", score))


def _variants(spark, sf_dir):
    """The vectors of a label as the variants of one record, each of a length of its own."""
    longer = F.transform("vec", lambda x: x * (1.0 + col("vec_id") / 100000.0))
    return _vectors(spark, sf_dir).select(
        col("label").alias("record_id"), col("vec_id").alias("variant"), longer.alias("vec")
    )


def multi_query_topk(spark, sf_dir):
    found = retrieval.multi_query_topk(_variants(spark, sf_dir), _universe(spark, sf_dir), K)
    return rounded(found)


def multi_query_uncut(spark, sf_dir):
    variants, universe = _variants(spark, sf_dir), _universe(spark, sf_dir)
    return rounded(retrieval.multi_query_topk(variants, universe, K, cut=False))


def _neighbours(spark, sf_dir):
    """Nearest other vectors, right where the label is the same."""
    found = _top(spark, sf_dir, K + 1).filter(col("code") != col("query_id")).drop("rank")
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = labels.select(col("vec_id").alias("query_id"), col("label").alias("query_label"))
    b = labels.select(col("vec_id").alias("code"), col("label").alias("code_label"))
    return (
        found.join(a, "query_id")
        .join(b, "code")
        .withColumn("relevant", (col("query_label") == col("code_label")).cast("int"))
    )


def retrieval_quality(spark, sf_dir):
    """MAP, MRR, P@1 and top-1 accuracy of the nearest others of every vector."""
    found = _neighbours(spark, sf_dir)
    return rounded(ranking.ranking_report(found, "query_id", "score", "code", "relevant"))


def rank_of_target(spark, sf_dir):
    """Where the list of every vector has the vector after it."""
    targets = table(spark, sf_dir, "embeddings").select(
        col("vec_id").alias("query_id"), (col("vec_id") + 1).alias("target")
    )
    return rounded(retrieval.rank_of_target(_top(spark, sf_dir), targets, ["query_id"]))


def _edges(spark, sf_dir):
    found = _neighbours(spark, sf_dir)
    return found.select(
        col("query_label").alias("block"),
        col("query_id").alias("query"),
        col("code").alias("doc"),
        "score",
    )


def assignment_bound(spark, sf_dir):
    """Per label, that the assignment is one and how far from the best it can be."""
    found = assign.assignment_bound(_edges(spark, sf_dir))
    return found.select("block", "n_queries", "repeated_queries", "repeated_docs", "unknown_edges", "within")


def topk_with_equal_ids(spark, sf_dir):
    """The vectors of a label are query rows of one id, each with a k of its own, in blocks."""
    queries = _vectors(spark, sf_dir).select("label", "vec", (col("vec_id") % 4).alias("wanted"))
    found = retrieval.topk_inner_product(
        queries, _universe(spark, sf_dir), col("wanted"), ["label"], block_bytes=100_000
    )
    return found.groupBy("label", "rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


# Texts: benchmark items look for the documents they resemble.

SIZE = 256


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(
        col("doc_id").cast("string").alias("code"),
        col("text").alias("name"),
        F.array(col("lang")).alias("synonyms"),
        F.lit(None).cast("string").alias("description"),
    )


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        col("item_id").alias("record_id"),
        col("item_id").cast("string").alias("code"),
        col("text").alias("name"),
    )


def text_universe(spark, sf_dir):
    return mapping.embed_universe(_documents(spark, sf_dir), SIZE)


def embed_text(spark, sf_dir):
    """Non-zero slots of the items' vectors, weighted on the documents."""
    model, _ = text_universe(spark, sf_dir)
    embedded = vectors.embed_text(model, items(spark, sf_dir), "name")
    slots = embedded.select("record_id", F.posexplode("vec").alias("slot", "value"))
    return rounded(slots.filter(col("value") != 0.0))


def retrieve(spark, sf_dir):
    model, universe = text_universe(spark, sf_dir)
    return rounded(retrieval.retrieve(items(spark, sf_dir), universe, model, 20))


def _item_synonyms(spark, sf_dir):
    """Two shorter wordings of every item: its first words and its later words."""
    words = similarity.word_list(col("name"))
    return items(spark, sf_dir).select(
        "record_id",
        F.array(
            F.array_join(F.slice(words, 1, 5), " "), F.lit(" "), F.array_join(F.slice(words, 4, 5), " ")
        ).alias("synonyms"),
    )


def retrieve_with_synonyms(spark, sf_dir):
    model, universe = text_universe(spark, sf_dir)
    synonyms = _item_synonyms(spark, sf_dir)
    return rounded(retrieval.retrieve(items(spark, sf_dir), universe, model, 20, synonyms))


def _item_dictionary(spark, sf_dir):
    """The first word of every item as a trigger for its second and third."""
    words = similarity.word_list(col("name"))
    entries = F.posexplode(F.slice(words, 2, 2)).alias("pos", "synonym")
    return items(spark, sf_dir).select(
        F.get(words, 0).alias("trigger"), col("record_id").alias("trigger_pos"), entries
    )


def retrieval_strategies(spark, sf_dir):
    model, universe = text_universe(spark, sf_dir)
    found = retrieval.retrieval_strategies(
        items(spark, sf_dir), universe, _item_dictionary(spark, sf_dir), model, 8, 5
    )
    return rounded(found)


def strategy_summary(spark, sf_dir):
    """Where each strategy ranks the document whose key is the item's."""
    model, universe = text_universe(spark, sf_dir)
    rows = items(spark, sf_dir)
    targets = rows.select("record_id", col("code").alias("target"))
    dictionary = _item_dictionary(spark, sf_dir)
    return rounded(mapping.diagnose_strategies(rows, universe, dictionary, model, targets, 8, 5))


def strategy_listing(spark, sf_dir):
    """The three best codes of every list with their names; the second of each list is one that nothing names."""
    model, universe = text_universe(spark, sf_dir)
    found = retrieval.retrieve(items(spark, sf_dir), universe, model, 20)
    found = found.withColumn("code", F.when(col("rank") == 2, F.concat(F.lit("x"), "code")).otherwise(col("code")))
    names = table(spark, sf_dir, "documents").select(col("doc_id").cast("string").alias("code"), col("source").alias("name"))
    return rounded(retrieval.strategy_listing(found, names, 3))


QUERIES = {
    "l2_normalize": l2_normalize,
    "cos_similarity": cos_similarity,
    "topk_inner_product": lambda s, d: rounded(_top(s, d)),
    "topk_inner_product_blocks": lambda s, d: rounded(
        _top(s, d, block_bytes=100_000)
    ),
    "retrieval_quality": retrieval_quality,
    "multi_query_topk": multi_query_topk,
    "multi_query_uncut": multi_query_uncut,
    "rank_of_target": rank_of_target,
    "mutual_best": lambda s, d: rounded(assign.mutual_best(_edges(s, d))),
    "one_to_one_assignment": lambda s, d: rounded(assign.one_to_one_assignment(_edges(s, d))),
    "assignment_bound": assignment_bound,
    "topk_with_equal_ids": topk_with_equal_ids,
    "embed_text": embed_text,
    "retrieve": retrieve,
    "retrieve_with_synonyms": retrieve_with_synonyms,
    "retrieval_strategies": retrieval_strategies,
    "strategy_summary": strategy_summary,
    "strategy_listing": strategy_listing,
}

TOP = """
unit AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / norm) AS vec
  FROM (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS code, a.label AS query_label, b.label AS code_label,
         list_inner_product(a.vec, b.vec) AS score
  FROM unit a CROSS JOIN unit b),
top AS (
  SELECT * FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code))::INTEGER AS rank FROM pairs)
  WHERE rank <= 10),
others AS (
  SELECT *, CASE WHEN query_label = code_label THEN 1 ELSE 0 END AS relevant FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code))::INTEGER AS rank
    FROM pairs WHERE code <> query_id)
  WHERE rank <= 10)"""

_TOP_SQL = f"WITH {TOP} SELECT query_id, code, round(score, 6) AS score, rank FROM top"

_MERGED = f"""WITH {TOP},
scaled AS (
  SELECT query_label AS record_id, query_id, code, score * (1.0::DOUBLE + query_id / 100000.0::DOUBLE) AS score FROM top),
best AS (
  SELECT record_id, code, max(score) AS score, arg_max(query_id, score) AS best_variant
  FROM scaled GROUP BY 1, 2),
merged AS (
  SELECT *, (row_number() OVER (PARTITION BY record_id ORDER BY score DESC, code))::INTEGER AS rank FROM best)"""


def murmur3_sql(words: str, size: int) -> str:
    """CTE ``slots`` (word, slot): the 32-bit Murmur3 hash, seed 42, of every word, modulo ``size``."""

    def mixed(k: str) -> str:
        # k * c1, rotate left 15, * c2, all modulo 2 ** 32
        for step in (
            "(({k})::HUGEINT * 3432918353 % 4294967296)",
            "(({k}) * 32768 % 4294967296 + ({k}) // 131072)",
            "(({k})::HUGEINT * 461845907 % 4294967296)",
        ):
            k = step.format(k=k)
        return f"({k})::BIGINT"

    return f"""
bytes AS (
  SELECT word, length(word) AS n, list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM {words})),
chunks AS (
  SELECT word, n,
    list_transform(range(n // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS ks,
    CASE WHEN n % 4 > 0 THEN b[4 * (n // 4) + 1] ELSE 0 END
    + CASE WHEN n % 4 > 1 THEN b[4 * (n // 4) + 2] * 256 ELSE 0 END
    + CASE WHEN n % 4 > 2 THEN b[4 * (n // 4) + 3] * 65536 ELSE 0 END AS tail
  FROM bytes),
bodies AS (
  SELECT word, n, {mixed("tail")} AS tail,
    list_reduce(list_prepend(42::BIGINT, list_transform(ks, lambda k: {mixed("k")})),
      lambda h, k: ((xor(h, k) * 8192 % 4294967296 + xor(h, k) // 524288) * 5 + 3864292196) % 4294967296) AS h
  FROM chunks),
h1 AS (SELECT word, xor(xor(h, tail), n) AS h FROM bodies),
h2 AS (SELECT word, (xor(h, h // 65536)::HUGEINT * 2246822507 % 4294967296)::BIGINT AS h FROM h1),
h3 AS (SELECT word, (xor(h, h // 8192)::HUGEINT * 3266489909 % 4294967296)::BIGINT AS h FROM h2),
slots AS (SELECT word, (xor(h, h // 65536) % {size})::INTEGER AS slot FROM h3)"""


# Needs the CTE ``texts`` (text). Gives ``found``: every text with every document.
EMBED = f"""
universe AS (
  SELECT doc_id::VARCHAR AS code, source, lang, doc_id || ' | ' || text || ' | ' || lang AS text FROM documents),
every_text AS (SELECT DISTINCT text FROM (SELECT text FROM texts UNION ALL SELECT text FROM universe)),
tokens AS (SELECT text, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM every_text),
{murmur3_sql("tokens", SIZE)},
tf AS (SELECT text, slot, count(*) AS n FROM tokens JOIN slots USING (word) GROUP BY ALL),
idf AS (
  SELECT slot, ln(((SELECT count(*) FROM universe) + 1.0::DOUBLE) / (count(DISTINCT code) + 1.0::DOUBLE)) AS idf
  FROM universe JOIN tf USING (text) GROUP BY slot),
weights AS (SELECT text, slot, n * coalesce(idf, ln((SELECT count(*) FROM universe) + 1.0::DOUBLE)) AS w FROM tf LEFT JOIN idf USING (slot)),
norms AS (SELECT text, sqrt(sum(w * w)) AS norm FROM weights GROUP BY text),
grid AS (SELECT text, unnest(range({SIZE}))::INTEGER AS slot FROM every_text),
vectors AS (
  SELECT text, list(coalesce(w / nullif(norm, 0), 0.0) ORDER BY slot) AS vec
  FROM grid LEFT JOIN weights USING (text, slot) LEFT JOIN norms USING (text) GROUP BY text),
wanted AS (SELECT DISTINCT text FROM texts),
found AS (
  SELECT q.text, u.code, list_inner_product(q.vec, v.vec) AS score
  FROM wanted JOIN vectors q USING (text) CROSS JOIN universe u JOIN vectors v ON v.text = u.text),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY text ORDER BY round(score, 12) DESC, code))::INTEGER AS rank FROM found)"""

ITEMS = """
items AS (
  SELECT item_id AS record_id, item_id::VARCHAR AS code, text AS name,
         regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM benchmark)"""

SYNONYM_TEXTS = """
texts AS (
  SELECT record_id, 0 AS variant, name AS text FROM items
  UNION ALL SELECT record_id, 1, array_to_string(words[1:5], ' ') FROM items WHERE len(words) > 0
  UNION ALL SELECT record_id, 2, array_to_string(words[4:8], ' ') FROM items WHERE len(words) > 3)"""

STRATEGIES = f"""WITH {ITEMS},
entries AS (
  SELECT words[1] AS trigger, record_id AS trigger_pos, pos, words[pos + 2] AS synonym
  FROM items CROSS JOIN (SELECT unnest([0, 1]) AS pos) WHERE len(words) >= pos + 2),
dictionary AS (
  SELECT trigger, min(trigger_pos) AS trigger_pos, list(synonym ORDER BY pos, synonym) AS synonyms
  FROM entries GROUP BY trigger),
hits AS (
  SELECT record_id, list(synonyms ORDER BY trigger_pos) AS hits
  FROM items JOIN dictionary ON contains(lower(name), trigger) GROUP BY record_id),
expanded AS (SELECT items.*, coalesce(hits, []::VARCHAR[][]) AS hits FROM items LEFT JOIN hits USING (record_id)),
texts AS (
  SELECT 'baseline' AS strategy, record_id, 8 AS k, code || ' | ' || name AS text FROM expanded
  UNION ALL SELECT 'name_only', record_id, 8, name FROM expanded
  UNION ALL SELECT 'synonym_expansion', record_id, 8,
    name || CASE WHEN len(hits) = 0 THEN '' ELSE ' | ' || array_to_string(flatten(hits), ' | ') END FROM expanded
  UNION ALL SELECT 'multi_query', record_id, 8, unnest(list_concat([name], coalesce(hits[1], []::VARCHAR[]))) FROM expanded
  UNION ALL SELECT 'large_k_5x', record_id, 40, name FROM expanded),
{EMBED},
best AS (
  SELECT strategy, record_id, code, max(score) AS score
  FROM texts JOIN ranked USING (text) WHERE rank <= k GROUP BY ALL),
merged AS (
  SELECT *, (row_number() OVER (PARTITION BY strategy, record_id ORDER BY round(score, 12) DESC, code))::INTEGER AS rank
  FROM best)"""

SQL = {
    "l2_normalize": """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 0.5::DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM v)
SELECT vec_id, (generate_subscripts(v, 1) - 1)::INTEGER AS pos, round(unnest(v) / norm, 6) + 0.0::DOUBLE AS x FROM n""",
    "cos_similarity": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cos_similarity
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "topk_inner_product": _TOP_SQL,
    "topk_inner_product_blocks": _TOP_SQL,
    "retrieval_quality": f"""WITH {TOP},
marked AS (
  SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM others),
measures AS (
  SELECT query_id, coalesce(sum(CASE WHEN relevant = 1 THEN seen::DOUBLE / rank END) / nullif(max(seen), 0), 0.0) AS ap,
         coalesce(1.0::DOUBLE / min(CASE WHEN relevant = 1 THEN rank END), 0.0) AS rr,
         max(CASE WHEN rank = 1 THEN relevant::DOUBLE END) AS first
  FROM marked GROUP BY query_id)
SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(first), 6) AS p_at_k,
       round(avg(first), 6) AS top1_accuracy FROM measures""",
    "multi_query_topk": f"""{_MERGED}
SELECT record_id, code, round(score, 6) AS score, best_variant, rank FROM merged WHERE rank <= 10""",
    "multi_query_uncut": f"{_MERGED} SELECT record_id, code, round(score, 6) AS score, best_variant, rank FROM merged",
    "rank_of_target": f"""WITH {TOP}
SELECT e.vec_id AS query_id, e.vec_id + 1 AS target, coalesce(rank, -1)::INTEGER AS rank,
       round(coalesce(score, 0.0), 6) AS score
FROM embeddings e LEFT JOIN top t ON t.query_id = e.vec_id AND t.code = e.vec_id + 1""",
    "mutual_best": f"""WITH {TOP},
a AS (SELECT * FROM others QUALIFY row_number() OVER (PARTITION BY query_label, query_id ORDER BY score DESC, code) = 1),
b AS (SELECT * FROM others QUALIFY row_number() OVER (PARTITION BY query_label, code ORDER BY score DESC, query_id) = 1)
SELECT query_label AS block, query_id AS query, code AS doc, round(a.score, 6) AS score
FROM a JOIN b USING (query_label, query_id, code)""",
    "assignment_bound": f"""WITH {TOP}
SELECT query_label AS block, count(DISTINCT query_id) AS n_queries, 0::BIGINT AS repeated_queries, 0::BIGINT AS repeated_docs,
       0::BIGINT AS unknown_edges, true AS within FROM others WHERE score > 0 GROUP BY 1""",
    "topk_with_equal_ids": f"""WITH {TOP}
SELECT query_label AS label, rank, count(*) AS n, round(sum(score), 4) AS total FROM top WHERE rank <= query_id % 4 GROUP BY 1, 2""",
    "embed_text": f"""WITH {ITEMS}, texts AS (SELECT name AS text FROM items), {EMBED}
SELECT record_id, slot, round(w / norm, 6) AS value
FROM items JOIN weights ON text = name JOIN norms USING (text) WHERE w <> 0""",
    "retrieve": f"""WITH {ITEMS}, texts AS (SELECT record_id, code || ' | ' || name AS text FROM items), {EMBED}
SELECT record_id, code, round(score, 6) AS score, rank FROM texts JOIN ranked USING (text) WHERE rank <= 20""",
    "retrieve_with_synonyms": f"""WITH {ITEMS}, {SYNONYM_TEXTS}, {EMBED},
best AS (SELECT record_id, code, max(score) AS score FROM texts JOIN ranked USING (text) WHERE rank <= 20 GROUP BY ALL),
merged AS (
  SELECT *, (row_number() OVER (PARTITION BY record_id ORDER BY round(score, 12) DESC, code))::INTEGER AS rank FROM best)
SELECT record_id, code, round(score, 6) AS score, rank FROM merged WHERE rank <= 20""",
    "retrieval_strategies": f"""{STRATEGIES}
SELECT strategy, record_id, code, round(score, 6) AS score, rank FROM merged""",
    "strategy_summary": f"""{STRATEGIES},
names AS (SELECT DISTINCT strategy FROM texts)
SELECT strategy, i.record_id, i.code AS target, coalesce(rank, -1)::INTEGER AS rank,
       round(coalesce(score, 0.0), 6) AS score, rank IS NOT NULL AS found
FROM items i CROSS JOIN names LEFT JOIN merged USING (strategy, record_id, code)""",
    "strategy_listing": f"""WITH {ITEMS}, texts AS (SELECT record_id, code || ' | ' || name AS text FROM items), {EMBED}
SELECT record_id, CASE WHEN rank = 2 THEN 'x' || r.code ELSE r.code END AS code, round(score, 6) AS score, rank,
       CASE WHEN rank <> 2 THEN source ELSE '<missing>' END AS name
FROM texts JOIN ranked r USING (text) JOIN universe u ON u.code = r.code WHERE rank <= 3""",
}
