"""Registered queries on candidates, prompts, answers and results, with the SQL that checks them.

Stand-in tables: customers are the records, the parts they bought are their
candidates, and each of their orders is an answer to one attempt.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from termbridge.catalog.base import table
from termbridge.catalog.vector_queries import EMBED, ITEMS, items, text_universe
from termbridge.functions import similarity
from termbridge.operators import prompts, resolve
from termbridge.operators.candidates import merge_candidates
from termbridge.operators.compare import multi_map_filter
from termbridge.operators.retrieval import retrieve
from termbridge.operators.skew import first_rows, number_rows
from termbridge.plans.mapping import map_records
from termbridge.schemas import CANDIDATES, MapperConfig
from termbridge.session import cut_lineage
from termbridge.sources.writers import flat_results

col = F.col
ATTEMPTS = 2


def _text(name):
    return col(name).cast("string")


def _lines(spark, sf_dir):
    """Order lines with the code they ask for: one that no universe has where the part was returned."""
    known = _text("l_partkey")
    code = F.when(col("l_returnflag") == "R", F.concat(F.lit("x"), known)).otherwise(known)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", code.alias("code"), "l_extendedprice")


def _bought(spark, sf_dir):
    """(record_id, code, score): the parts of every customer with their highest price."""
    lines = _lines(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, col("l_orderkey") == col("o_orderkey"))
        .groupBy(col("o_custkey").alias("record_id"), "code")
        .agg((F.max("l_extendedprice") / 105000.0).alias("score"))
    )


def universe(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_text("p_partkey").alias("code"), col("p_name").alias("name"))


def retrieved(bought):
    """The ten dearest parts of every customer."""
    order = [col("score").desc(), col("code").asc()]
    top = first_rows(bought, ["record_id"], order, 10)
    listed = top.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct((-col("score")).alias("s"), "code"))).alias("l")
    )
    rows = listed.select("record_id", F.posexplode("l").alias("at", "c"))
    return rows.select(
        "record_id", "c.code", (-col("c.s")).alias("score"), (col("at") + 1).alias("rank")
    )


def records(spark, sf_dir, bought):
    """Customers with their three cheapest parts as direct candidates, under odd names."""
    order = [col("score").asc(), col("code").asc()]
    cheap = first_rows(bought, ["record_id"], order, 3)
    given = (
        F.when(col("p_size") > 45, F.concat(F.lit("Unspecified "), col("p_type")))
        .when(col("p_size") >= 5, col("p_type"))
    )
    parts = table(spark, sf_dir, "part").select(_text("p_partkey").alias("part"), given.alias("name"))
    direct = (
        cheap.join(parts, F.ltrim("code", F.lit("x")) == col("part"))
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_list(F.struct("score", "code", "name"))).alias("l"))
        .select(
            "record_id",
            F.transform("l", lambda c: F.struct(c["code"].alias("code"), c["name"].alias("name"))).alias(
                "direct_candidates"
            ),
        )
    )
    customers = table(spark, sf_dir, "customer").select(
        col("c_custkey").alias("record_id"),
        col("c_name").alias("code"),
        col("c_mktsegment").alias("name"),
    )
    none = F.array().cast(CANDIDATES)
    # Customers of one market segment have no direct candidates at all.
    kept = F.when(col("name") != "BUILDING", col("direct_candidates"))
    return customers.join(direct, "record_id", "left").select(
        "record_id", "code", "name", F.coalesce(kept, none).alias("direct_candidates")
    )


def responses(spark, sf_dir, attempts=None):
    """Every order of a customer as an answer: some cut off, some incomplete, some with
    an unknown field, some that choose a part the customer has among the candidates.
    ``attempts`` leaves out the answers that a job of so many attempts never looks at."""
    lines = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min("code").alias("least"), F.max("code").alias("most"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    by_age = [col("o_orderkey").asc()]
    if attempts is None:
        made = number_rows(orders, ["o_custkey"], by_age, "nth")
    else:
        made = first_rows(orders, ["o_custkey"], by_age, attempts, "nth")
    numbered = (
        made.withColumns({"record_id": col("o_custkey"), "attempt_index": col("nth") - 1})
        .join(lines, col("o_orderkey") == col("l_orderkey"), "left")
    )
    priority, price = col("o_orderpriority"), col("o_totalprice")
    confidence = (
        F.when(priority == "1-URGENT", "strong")
        .when(priority == "2-HIGH", "medium")
        .when(priority == "3-MEDIUM", "weak")
        .when(priority == "4-NOT SPECIFIED", "no_confident_match")
        .otherwise("certain")
    )
    answer = F.to_json(
        F.struct(
            col("least").alias("best_match_icd10_code"),
            priority.alias("best_match_icd10_name"),
            confidence.alias("confidence"),
            F.when(price > 300000, "maybe an Error").otherwise("fits").alias("rationale"),
            F.lit("OTHER_MATCH").alias("mapping_category"),
            F.lit("CLOSE").alias("match_specificity"),
            F.lit("BAD_MAPPING").alias("external_choice_reason"),
            (price > 200000).alias("is_multi_map"),
            col("most").alias("more_broad_icd10_code"),
            priority.alias("more_broad_icd10_name"),
            F.when(price > 250000, col("least")).alias("closest_exact_icd10_code"),
            F.lit(None).cast("string").alias("closest_exact_icd10_name"),
        ),
        {"ignoreNullFields": "false"},
    )
    rest = F.substr(answer, F.lit(2))
    text = (
        F.when(col("o_orderstatus") == "P", F.substring(answer, 1, 40))
        .when(price < 50000, F.concat(F.lit('{"extra":1,'), rest))
        .when(price < 80000, F.lit('{"confidence":"strong"}'))
        .when(price < 100000, F.lit("[1, 2]"))
        .when(price < 120000, F.lit(None).cast("string"))
        .otherwise(answer)
    )
    return numbered.select("record_id", "attempt_index", text.alias("raw_text"))


def parsed(spark, sf_dir, attempts=None):
    return resolve.parse_response(responses(spark, sf_dir, attempts))


class Stage:
    """The stand-in tables up to the verdicts, each written once; verdicts of the first ``attempts`` answers, or of all."""

    def __init__(self, spark, sf_dir, attempts=ATTEMPTS):
        self.spark, self.sf_dir, self.attempts = spark, sf_dir, attempts
        bought = cut_lineage(_bought(spark, sf_dir))
        self.universe = universe(spark, sf_dir)
        self.records = cut_lineage(records(spark, sf_dir, bought))
        self.retrieved = cut_lineage(retrieved(bought))

    @cached_property
    def candidates(self):
        return cut_lineage(merge_candidates(self.records, self.retrieved, self.universe))

    @cached_property
    def verdicts(self):
        made = parsed(self.spark, self.sf_dir, self.attempts)
        return cut_lineage(resolve.validate_attempt(made, self.candidates))

    @cached_property
    def terminals(self):
        return resolve.first_terminal_attempt(self.verdicts, ATTEMPTS)

    def finalised(self):
        return resolve.finalise_selection(self.terminals, self.records)

    def canonical(self):
        return resolve.canonical_multi_map(self.finalised(), self.universe)

    def salvaged(self):
        return resolve.salvage(self.records, self.terminals, self.candidates, ATTEMPTS)

    def asked(self, attempts):
        base = prompts.selection_prompts(self.records, self.candidates, "RULES")
        return prompts.corrective_messages(self.verdicts, base, attempts)

    def results(self):
        selections = self.canonical().unionByName(self.salvaged())
        return resolve.assemble_result(self.records, selections, self.candidates, self.retrieved)


def results(spark, sf_dir):
    return Stage(spark, sf_dir).results()


def first_terminal_attempt(spark, sf_dir):
    return Stage(spark, sf_dir).terminals.select(
        "record_id",
        col("terminal.attempt_index").alias("attempt_index"),
        col("terminal.verdict").alias("verdict"),
        col("last_attempted.code").alias("last_code"),
        col("last_attempted.name").alias("last_name"),
        "last_error",
    )


def assemble_result(spark, sf_dir):
    whole = results(spark, sf_dir)
    allowed = F.transform(
        "allowed_candidates", lambda c: F.concat_ws(":", c["code"], c["source"], c["name"])
    )
    return whole.select(
        "record_id",
        "input.icd9_code",
        F.size("input.direct_candidates").alias("n_direct"),
        "selected_code",
        "selected_name",
        "confidence",
        "num_attempts",
        "salvage_strategy",
        F.array_join(allowed, "|").alias("allowed"),
        "retrieved_top_k",
    )


def candidate_block(spark, sf_dir):
    stage = Stage(spark, sf_dir)
    blocks = prompts.candidate_block(stage.records, stage.candidates)
    return blocks.withColumn("direct_codes", F.array_join("direct_codes", ","))


def response_schema(spark, sf_dir):
    stage = Stage(spark, sf_dir)
    return prompts.response_schema(stage.records, stage.candidates)


def selection_prompts(spark, sf_dir):
    stage = Stage(spark, sf_dir)
    asked = prompts.selection_prompts(stage.records, stage.candidates, "RULES")
    lines = asked.select("record_id", F.posexplode("messages").alias("pos", "m"))
    return lines.select("record_id", "pos", "m.role", "m.content")


def synonym_prompts(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        col("c_custkey").alias("record_id"), col("c_name").alias("code"), col("c_mktsegment").alias("name")
    )
    asked = prompts.synonym_prompts(customers, "RULES")
    lines = asked.select("record_id", F.posexplode("messages").alias("pos", "m"))
    return lines.select("record_id", "pos", "m.role", "m.content")


def corrective_messages(spark, sf_dir):
    """How many messages each attempt was sent, and the last one's role and text."""
    last = F.element_at("messages", -1)
    return Stage(spark, sf_dir, 3).asked(3).select(
        "record_id",
        "attempt_index",
        F.size("messages").alias("n_messages"),
        last["role"].alias("role"),
        F.when(last["role"] == "system", last["content"]).alias("line"),
    )


def next_attempt_messages(spark, sf_dir):
    """Who is to be asked again, at which attempt and with how many messages."""
    stage = Stage(spark, sf_dir, 3)
    base = prompts.selection_prompts(stage.records, stage.candidates, "RULES")
    asked = prompts.next_attempt_messages(base, stage.verdicts, 3)
    last = F.element_at("messages", -1)
    return asked.select("record_id", "attempt_index", F.size("messages").alias("n_messages"), last["role"].alias("role"))


def attempt_audit(spark, sf_dir):
    """The log of every record's attempts, one row per entry."""
    stage = Stage(spark, sf_dir)
    schemas = prompts.response_schema(stage.records, stage.candidates)
    log = resolve.attempt_audit(stage.verdicts, stage.asked(ATTEMPTS), schemas, ATTEMPTS)
    entries = log.select("record_id", F.posexplode("attempts").alias("pos", "e"))
    return entries.select(
        "record_id",
        "pos",
        "e.attempt_index",
        F.size("e.messages").alias("n_messages"),
        "e.validation_error",
        "e.note",
        "e.attempted_code",
        (F.length("e.json_schema") > 0).alias("has_schema"),
    )


def _item_responses(spark, sf_dir, found):
    """Two answers per item that choose the retrieved code at the rank of the item's word
    count: none for items longer than the list. The first answer cannot be read where
    the item has several lines."""
    sized = items(spark, sf_dir).select(
        "record_id",
        F.size(similarity.word_list(col("name"))).alias("rank"),
        F.contains("name", F.lit("\n")).alias("lines"),
        F.startswith("name", F.lit("T")).alias("unsure"),
    )
    tries = found.join(sized, ["record_id", "rank"]).withColumn(
        "attempt_index", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    answer = F.to_json(
        F.struct(
            col("code").alias("best_match_icd10_code"),
            F.lit("").alias("best_match_icd10_name"),
            F.when(col("unsure"), "no_confident_match").otherwise("strong").alias("confidence"),
            F.lit("fits").alias("rationale"),
            F.lit("OTHER_MATCH").alias("mapping_category"),
            F.lit("EXACT").alias("match_specificity"),
            F.lit("N/A").alias("external_choice_reason"),
        )
    )
    text = F.when((col("attempt_index") == 0) & col("lines"), F.lit("sorry")).otherwise(answer)
    return tries.select("record_id", "attempt_index", text.alias("raw_text"))


def mapped(spark, sf_dir, audit=False):
    """The whole job: benchmark items mapped to documents."""
    model, documents = text_universe(spark, sf_dir)
    rows = items(spark, sf_dir).withColumn("direct_candidates", F.array().cast(CANDIDATES))
    found = cut_lineage(retrieve(rows, documents, model, 40))
    answers = _item_responses(spark, sf_dir, found)
    config = MapperConfig(retrieve_top_k=40, max_attempts=ATTEMPTS, audit=audit)
    return map_records(rows, documents, model, answers, config)


def map_records_query(spark, sf_dir):
    return mapped(spark, sf_dir).select(
        "record_id",
        "selected_code",
        F.length("selected_name").alias("name_length"),
        "confidence",
        "rationale",
        "mapping_category",
        "chosen_source",
        "num_attempts",
        "attempted_returned_code",
        "salvage_strategy",
        F.size("allowed_candidates").alias("n_allowed"),
        "retrieved_top_k",
    )


def map_records_audited(spark, sf_dir):
    whole = mapped(spark, sf_dir, audit=True)
    return whole.select("record_id", F.size("audit.attempts").alias("n_entries"))


def answer_violations(spark, sf_dir):
    read = cut_lineage(parsed(spark, sf_dir))
    found = resolve.answer_violations(read).filter(F.size("violations") > 0)
    return found.select("record_id", "attempt_index", F.array_join("violations", ",").alias("violations"))


QUERIES = {
    "merge_candidates": lambda s, d: Stage(s, d).candidates,
    "candidate_block": candidate_block,
    "selection_prompts": selection_prompts,
    "response_schema": response_schema,
    "synonym_prompts": synonym_prompts,
    "parse_response": lambda s, d: parsed(s, d).drop("raw_text"),
    "answer_violations": answer_violations,
    "validate_attempt": lambda s, d: Stage(s, d, None).verdicts.select(
        "record_id", "attempt_index", "best_match_icd10_code", "candidate_name", "candidate_source", "verdict"
    ),
    "first_terminal_attempt": first_terminal_attempt,
    "corrective_messages": corrective_messages,
    "next_attempt_messages": next_attempt_messages,
    "finalise_selection": lambda s, d: Stage(s, d).finalised(),
    "canonical_multi_map": lambda s, d: Stage(s, d)
    .canonical()
    .select("record_id", *resolve.MULTI_MAP_FIELDS),
    "salvage": lambda s, d: Stage(s, d).salvaged(),
    "assemble_result": assemble_result,
    "attempt_audit": attempt_audit,
    "multi_map_filter": lambda s, d: multi_map_filter(flat_results(results(s, d))),
    "map_records": map_records_query,
    "map_records_audited": map_records_audited,
}

# CTEs records, direct, retrieved, known and answers of the customer stand-in.
CUSTOMERS = """
lines AS (
  SELECT l_orderkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 'x' ELSE '' END || l_partkey::VARCHAR AS code FROM lineitem),
bought AS (
  SELECT o_custkey AS record_id, code, max(l_extendedprice) / 105000.0::DOUBLE AS score
  FROM lines JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
known AS (SELECT p_partkey::VARCHAR AS code, p_name AS name FROM part),
retrieved AS (
  SELECT record_id, code, score,
         (row_number() OVER (PARTITION BY record_id ORDER BY score DESC, code))::INTEGER AS rank
  FROM bought QUALIFY rank <= 10),
records AS (SELECT c_custkey AS record_id, c_name AS code, c_mktsegment AS name FROM customer),
direct AS (
  SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY score, code) AS spot, code,
         CASE WHEN p_size > 45 THEN 'Unspecified ' || p_type WHEN p_size >= 5 THEN p_type END AS given
  FROM (SELECT * FROM bought QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score, code) <= 3)
  JOIN part ON p_partkey::VARCHAR = ltrim(code, 'x')
  WHERE record_id IN (SELECT record_id FROM records WHERE name <> 'BUILDING')),
ends AS (SELECT l_orderkey, min(code) AS least, max(code) AS most FROM lines GROUP BY 1),
tried AS (
  SELECT o_custkey AS record_id, *,
         (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS attempt_index
  FROM orders),
judged AS (
  SELECT *, CASE
      WHEN o_orderstatus = 'P' THEN 'Invalid JSON returned'
      WHEN o_totalprice < 50000 THEN 'Schema validation failed: unknown extra'
      WHEN o_totalprice < 80000 THEN 'Schema validation failed: missing best_match_icd10_code, best_match_icd10_name, rationale, mapping_category, match_specificity, external_choice_reason'
      WHEN o_totalprice < 100000 THEN 'Schema validation failed: not an object'
      WHEN o_totalprice < 120000 THEN 'Schema validation failed: missing best_match_icd10_code, best_match_icd10_name, confidence, rationale, mapping_category, match_specificity, external_choice_reason'
    END AS error
  FROM tried LEFT JOIN ends ON l_orderkey = o_orderkey),
answers AS (
  SELECT record_id, attempt_index, error, least AS best_match_icd10_code, o_orderpriority AS best_match_icd10_name,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'strong' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'weak'
      WHEN '4-NOT SPECIFIED' THEN 'no_confident_match' ELSE 'certain' END AS confidence,
    CASE WHEN o_totalprice > 300000 THEN 'maybe an Error' ELSE 'fits' END AS rationale,
    'OTHER_MATCH' AS mapping_category, 'CLOSE' AS match_specificity, 'BAD_MAPPING' AS external_choice_reason,
    o_totalprice > 200000 AS is_multi_map, most AS more_broad_icd10_code, o_orderpriority AS more_broad_icd10_name,
    CASE WHEN o_totalprice > 250000 THEN least END AS closest_exact_icd10_code,
    NULL::VARCHAR AS closest_exact_icd10_name
  FROM judged WHERE error IS NULL
  UNION ALL
  SELECT record_id, attempt_index, error, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, NULL
  FROM judged WHERE error IS NOT NULL)"""

CANDIDATES_SQL = """
options AS (
  SELECT d.record_id, 0 AS kind, spot, d.code, coalesce(k.name, given, '') AS name, 'direct' AS source,
         NULL::DOUBLE AS score, k.code IS NOT NULL AS in_universe
  FROM direct d LEFT JOIN known k USING (code)
  UNION ALL
  SELECT r.record_id, 1, rank, r.code, k.name, 'retrieved', r.score, true FROM retrieved r JOIN known k USING (code)),
candidates AS (
  SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY kind, spot))::INTEGER AS pos,
         code, name, source, score, in_universe
  FROM (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY record_id, code ORDER BY kind, spot) = 1))"""

RESOLVE = f"""{CANDIDATES_SQL},
verdicts AS (
  SELECT a.*, c.name AS candidate_name, c.source AS candidate_source,
    CASE WHEN error IS NOT NULL THEN 'error' WHEN c.code IS NOT NULL AND (c.source = 'direct' OR c.in_universe) THEN 'valid'
      WHEN confidence = 'no_confident_match' THEN 'no_match' ELSE 'invalid' END AS verdict
  FROM answers a LEFT JOIN candidates c ON c.record_id = a.record_id AND c.code = a.best_match_icd10_code),
made AS (SELECT * FROM verdicts WHERE attempt_index < {ATTEMPTS}),
done AS (
  SELECT * FROM made WHERE verdict IN ('valid', 'no_match')
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY attempt_index) = 1),
last_seen AS (
  SELECT * FROM made WHERE verdict <> 'error'
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY attempt_index DESC) = 1),
failures AS (
  SELECT record_id, coalesce(error, 'Selected invalid code') AS last_error FROM made
  WHERE verdict IN ('error', 'invalid')
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY attempt_index DESC) = 1),
marked AS (
  SELECT *, verdict = 'valid' AS ok, verdict = 'valid' AND confidence = 'no_confident_match' AS odd,
         EXISTS (SELECT 1 FROM direct d WHERE d.record_id = done.record_id AND d.code = best_match_icd10_code) AS is_direct
  FROM done),
finalised AS (
  SELECT record_id, CASE WHEN ok THEN best_match_icd10_code END AS selected_code,
    CASE WHEN ok THEN candidate_name END AS selected_name,
    CASE WHEN odd THEN 'weak' ELSE confidence END AS confidence,
    CASE WHEN odd AND (contains(lower(rationale), 'invalid') OR contains(lower(rationale), 'error'))
      THEN 'Code selected but with low confidence due to contradictory LLM output' ELSE rationale END AS rationale,
    CASE WHEN NOT ok THEN 'NONE' WHEN is_direct THEN 'DIRECT_MATCH' ELSE 'OTHER_MATCH' END AS mapping_category,
    match_specificity, CASE WHEN ok THEN external_choice_reason ELSE 'N/A' END AS external_choice_reason,
    CASE WHEN ok THEN candidate_source END AS chosen_source,
    CASE WHEN odd THEN 'LLM returned valid code ''' || best_match_icd10_code ||
        ''' but with contradictory ''no_confident_match'' confidence. Corrected to ''weak''. Original rationale: ''' ||
        rationale || ''''
      WHEN NOT ok THEN 'No confident match accepted.' END AS validator_notes,
    attempt_index + 1 AS num_attempts, best_match_icd10_code AS attempted_returned_code,
    best_match_icd10_name AS attempted_returned_name,
    CASE WHEN odd THEN 'corrected_confidence_from_no_match_to_weak' END AS salvage_strategy,
    ok AND is_multi_map AS is_multi_map, CASE WHEN ok THEN more_broad_icd10_code END AS more_broad_icd10_code,
    CASE WHEN ok THEN more_broad_icd10_name END AS more_broad_icd10_name,
    CASE WHEN ok THEN closest_exact_icd10_code END AS closest_exact_icd10_code,
    CASE WHEN ok THEN closest_exact_icd10_name END AS closest_exact_icd10_name
  FROM marked),
canonical AS (
  SELECT f.* REPLACE (coalesce(b.name, more_broad_icd10_name) AS more_broad_icd10_name,
                      coalesce(e.name, closest_exact_icd10_name) AS closest_exact_icd10_name)
  FROM finalised f LEFT JOIN known b ON b.code = more_broad_icd10_code
  LEFT JOIN known e ON e.code = closest_exact_icd10_code),
first_direct AS (SELECT * FROM direct QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY spot) = 1),
unspecified AS (
  SELECT * FROM direct WHERE contains(lower(coalesce(given, '')), 'unspecified')
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY spot) = 1),
top_retrieved AS (
  SELECT * FROM candidates WHERE source = 'retrieved'
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, pos) = 1),
fallback AS (
  SELECT r.record_id, l.best_match_icd10_code AS attempted, l.best_match_icd10_name AS attempted_name, last_error,
    CASE WHEN c.code IS NOT NULL THEN c.code WHEN f.code IS NOT NULL THEN coalesce(u.code, f.code) ELSE t.code END AS code,
    CASE WHEN c.code IS NOT NULL THEN c.name
      WHEN u.code IS NOT NULL THEN coalesce(ku.name, u.given) WHEN f.code IS NOT NULL THEN coalesce(kf.name, f.given)
      ELSE t.name END AS name
  FROM records r ANTI JOIN done USING (record_id) LEFT JOIN last_seen l ON l.record_id = r.record_id
  LEFT JOIN failures x ON x.record_id = r.record_id
  LEFT JOIN candidates c ON c.record_id = r.record_id AND c.code = l.best_match_icd10_code
  LEFT JOIN first_direct f ON f.record_id = r.record_id LEFT JOIN unspecified u ON u.record_id = r.record_id
  LEFT JOIN known kf ON kf.code = f.code LEFT JOIN known ku ON ku.code = u.code
  LEFT JOIN top_retrieved t ON t.record_id = r.record_id),
fallback_marked AS (
  SELECT *, EXISTS (SELECT 1 FROM direct d WHERE d.record_id = fallback.record_id AND d.code = fallback.code) AS is_direct,
    EXISTS (SELECT 1 FROM direct d WHERE d.record_id = fallback.record_id AND d.code = fallback.code
            AND contains(lower(coalesce(given, '')), 'unspecified')) AS is_unspecified
  FROM fallback),
salvaged AS (
  SELECT record_id, code AS selected_code, name AS selected_name, 'no_confident_match' AS confidence,
    coalesce(last_error, 'Unable to obtain valid selection') AS rationale,
    CASE WHEN code IS NULL THEN 'NONE' WHEN is_direct THEN 'DIRECT_MATCH' ELSE 'OTHER_MATCH' END AS mapping_category,
    'MORE_BROAD' AS match_specificity, 'N/A' AS external_choice_reason,
    CASE WHEN code IS NULL THEN NULL WHEN is_direct THEN 'direct' ELSE 'retrieved' END AS chosen_source,
    'LLM attempts exhausted' AS validator_notes, {ATTEMPTS} AS num_attempts,
    attempted AS attempted_returned_code, attempted_name AS attempted_returned_name,
    CASE WHEN code IS NULL THEN 'none' WHEN code = attempted THEN 'attempted_code' WHEN is_unspecified THEN 'direct_unspecified'
      WHEN is_direct THEN 'direct_first' ELSE 'retrieved_top' END AS salvage_strategy,
    false AS is_multi_map, NULL::VARCHAR AS more_broad_icd10_code, NULL::VARCHAR AS more_broad_icd10_name,
    NULL::VARCHAR AS closest_exact_icd10_code, NULL::VARCHAR AS closest_exact_icd10_name
  FROM fallback_marked),
selections AS (SELECT * FROM canonical UNION ALL BY NAME SELECT * FROM salvaged)"""

BLOCKS = """
blocks AS (
  SELECT r.record_id, coalesce(string_agg('- ' || c.code || ': ' || c.name || ' [source=' || source ||
      CASE WHEN score IS NULL THEN '' ELSE printf(', score=%.3f', score) END || ']', chr(10) ORDER BY pos), '(none)') AS block,
    coalesce(list(c.code ORDER BY c.code) FILTER (source = 'direct'), []::VARCHAR[]) AS direct_codes
  FROM records r LEFT JOIN candidates c USING (record_id) GROUP BY r.record_id)"""

_NOTE = f"""CASE verdict WHEN 'error' THEN '{prompts.INVALID_OUTPUT_NOTE}' WHEN 'invalid' THEN '{prompts.INVALID_CODE_NOTE}' END"""

_CUSTOMER = f"WITH {CUSTOMERS}, {RESOLVE}"
_ENUM = '{{"type":"string","enum":[{}]}}'


def _words(values):
    return _ENUM.format(",".join(f'"{v}"' for v in values))


_CODES = """{"anyOf":[{"type":"string","enum":' || codes || '},{"type":"null"}]}"""
_TEXT_OR_NULL = '{"type":["string","null"]}'

MAPPED = f"""WITH {ITEMS}, texts AS (SELECT record_id, code || ' | ' || name AS text FROM items), {EMBED},
records AS (SELECT record_id, code, name FROM items),
direct AS (SELECT 0::BIGINT AS record_id, 0 AS spot, '' AS code, '' AS given WHERE false),
known AS (SELECT doc_id::VARCHAR AS code, text AS name FROM documents),
retrieved AS (SELECT record_id, code, score, rank FROM texts JOIN ranked USING (text) WHERE rank <= 40),
answers AS (
  SELECT record_id, t AS attempt_index, CASE WHEN bad THEN 'Invalid JSON returned' END AS error,
    CASE WHEN NOT bad THEN code END AS best_match_icd10_code, CASE WHEN NOT bad THEN '' END AS best_match_icd10_name,
    CASE WHEN bad THEN NULL WHEN unsure THEN 'no_confident_match' ELSE 'strong' END AS confidence,
    CASE WHEN NOT bad THEN 'fits' END AS rationale, CASE WHEN NOT bad THEN 'OTHER_MATCH' END AS mapping_category,
    CASE WHEN NOT bad THEN 'EXACT' END AS match_specificity, CASE WHEN NOT bad THEN 'N/A' END AS external_choice_reason,
    false AS is_multi_map, NULL::VARCHAR AS more_broad_icd10_code, NULL::VARCHAR AS more_broad_icd10_name,
    NULL::VARCHAR AS closest_exact_icd10_code, NULL::VARCHAR AS closest_exact_icd10_name
  FROM (SELECT retrieved.*, t, t = 0 AND contains(name, chr(10)) AS bad, name[1] = 'T' AS unsure
        FROM retrieved JOIN items USING (record_id) CROSS JOIN (SELECT unnest([0, 1]) AS t)
        WHERE rank = len(words))),
{RESOLVE},
lists AS (SELECT record_id, count(*)::INTEGER AS n_allowed FROM candidates GROUP BY 1),
sizes AS (SELECT record_id, count(*)::INTEGER AS retrieved_top_k FROM retrieved GROUP BY 1)"""

SQL = {
    "merge_candidates": f"""WITH {CUSTOMERS}, {CANDIDATES_SQL}
SELECT record_id, pos, code, name, source, score, in_universe FROM candidates""",
    "candidate_block": f"""WITH {CUSTOMERS}, {CANDIDATES_SQL}, {BLOCKS}
SELECT record_id, block AS candidate_block, array_to_string(direct_codes, ',') AS direct_codes FROM blocks""",
    "selection_prompts": f"""WITH {CUSTOMERS}, {CANDIDATES_SQL}, {BLOCKS}
SELECT record_id, 0 AS pos, 'system' AS role, 'RULES' AS content FROM records
UNION ALL
SELECT record_id, 1, 'user', 'Source term' || chr(10) || 'code: ' || code || chr(10) || 'name: ' || name || chr(10) || chr(10) ||
  'ALLOWED_CANDIDATES' || chr(10) || block || chr(10) || chr(10) || 'DIRECT codes: [' || array_to_string(direct_codes, ', ') ||
  ']' || chr(10) || 'Choose one code from ALLOWED_CANDIDATES, or none.'
FROM records JOIN blocks USING (record_id)""",
    "response_schema": f"""WITH {CUSTOMERS}, {CANDIDATES_SQL},
listed AS (
  SELECT r.record_id, '[' || coalesce(string_agg('"' || c.code || '"', ',' ORDER BY c.code), '') || ']' AS codes
  FROM records r LEFT JOIN candidates c USING (record_id) GROUP BY r.record_id)
SELECT record_id, '{{"name":"mapping_response","schema":{{"type":"object","additionalProperties":false,"properties":{{'
  || '"best_match_icd10_code":{_CODES},"best_match_icd10_name":{_TEXT_OR_NULL},'
  || '"confidence":{_words(["strong", "medium", "weak", "no_confident_match"])},"rationale":{{"type":"string"}},'
  || '"mapping_category":{_words(["NONE", "DIRECT_MATCH", "OTHER_MATCH"])},"is_multi_map":{{"type":"boolean"}},'
  || '"match_specificity":{_words(["EXACT", "CLOSE", "MORE_BROAD"])},'
  || '"external_choice_reason":{_words(["MULTIMAP", "BAD_MAPPING", "N/A"])},'
  || '"more_broad_icd10_code":{_CODES},"more_broad_icd10_name":{_TEXT_OR_NULL},'
  || '"closest_exact_icd10_code":{_CODES},"closest_exact_icd10_name":{_TEXT_OR_NULL}}},'
  || '"required":["best_match_icd10_code","best_match_icd10_name","confidence","rationale","mapping_category",'
  || '"match_specificity","external_choice_reason","is_multi_map"]}},"strict":true}}' AS schema_json
FROM listed""",
    "synonym_prompts": f"""WITH {CUSTOMERS}
SELECT record_id, 0 AS pos, 'system' AS role, 'RULES' AS content FROM records
UNION ALL
SELECT record_id, 1, 'user', 'Source term' || chr(10) || 'code: ' || code || chr(10) || 'name: ' || name || chr(10) || chr(10) ||
  'List its synonyms.' FROM records""",
    "parse_response": f"WITH {CUSTOMERS} SELECT * FROM answers",
    "answer_violations": f"""WITH {CUSTOMERS}
SELECT record_id, attempt_index, 'confidence' AS violations FROM answers WHERE confidence = 'certain'""",
    "validate_attempt": f"""{_CUSTOMER}
SELECT record_id, attempt_index, best_match_icd10_code, candidate_name, candidate_source, verdict FROM verdicts""",
    "first_terminal_attempt": f"""{_CUSTOMER}
SELECT m.record_id, d.attempt_index, d.verdict, l.best_match_icd10_code AS last_code, l.best_match_icd10_name AS last_name, last_error
FROM (SELECT DISTINCT record_id FROM made) m LEFT JOIN done d USING (record_id)
LEFT JOIN last_seen l ON l.record_id = m.record_id LEFT JOIN failures f ON f.record_id = m.record_id""",
    "corrective_messages": f"""{_CUSTOMER},
noted AS (
  SELECT record_id, attempt_index,
    count({_NOTE}) OVER w AS n,
    last_value({_NOTE} IGNORE NULLS) OVER w AS line
  FROM verdicts WINDOW w AS (PARTITION BY record_id ORDER BY attempt_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT record_id, attempt_index, (n + 2)::INTEGER AS n_messages, CASE WHEN n = 0 THEN 'user' ELSE 'system' END AS role,
       line FROM noted WHERE attempt_index < 3""",
    "next_attempt_messages": f"""{_CUSTOMER},
spent AS (
  SELECT record_id, (max(attempt_index) + 1)::INTEGER AS following, bool_or(verdict IN ('valid', 'no_match')) AS settled, count({_NOTE}) AS n
  FROM verdicts WHERE attempt_index < 3 GROUP BY 1)
SELECT record_id, coalesce(following, 0)::INTEGER AS attempt_index, (coalesce(n, 0) + 2)::INTEGER AS n_messages,
       CASE WHEN coalesce(n, 0) = 0 THEN 'user' ELSE 'system' END AS role
FROM records LEFT JOIN spent USING (record_id) WHERE NOT coalesce(settled, false) AND coalesce(following, 0) < 3""",
    "finalise_selection": f"{_CUSTOMER} SELECT * FROM finalised",
    "canonical_multi_map": f"{_CUSTOMER} SELECT record_id, {', '.join(resolve.MULTI_MAP_FIELDS)} FROM canonical",
    "salvage": f"{_CUSTOMER} SELECT * FROM salvaged",
    "assemble_result": f"""{_CUSTOMER},
lists AS (SELECT record_id, string_agg(code || ':' || source || ':' || name, '|' ORDER BY pos) AS allowed FROM candidates GROUP BY 1),
sizes AS (SELECT record_id, count(*)::INTEGER AS retrieved_top_k FROM retrieved GROUP BY 1),
directs AS (SELECT record_id, count(*)::INTEGER AS n FROM direct GROUP BY 1)
SELECT r.record_id, r.code AS icd9_code, coalesce(n, 0) AS n_direct, selected_code, selected_name, confidence, num_attempts,
       salvage_strategy, coalesce(allowed, '') AS allowed, coalesce(retrieved_top_k, 0) AS retrieved_top_k
FROM records r JOIN selections s USING (record_id) LEFT JOIN lists USING (record_id) LEFT JOIN sizes USING (record_id)
LEFT JOIN directs USING (record_id)""",
    "attempt_audit": f"""{_CUSTOMER},
logged AS (
  SELECT m.*, (SELECT count(*) FROM made p WHERE p.record_id = m.record_id AND p.attempt_index < m.attempt_index) AS before
  FROM made m LEFT JOIN done d USING (record_id) WHERE d.attempt_index IS NULL OR m.attempt_index <= d.attempt_index),
entries AS (
  SELECT record_id, attempt_index, 0 AS step, before + 2 AS n, NULL AS validation_error, NULL AS note,
         best_match_icd10_code AS attempted_code FROM logged WHERE verdict <> 'error'
  UNION ALL
  SELECT record_id, attempt_index, 1, before + 3, coalesce(error, 'Selected invalid code'),
    CASE verdict WHEN 'error' THEN 'Validation error; added corrective system message'
                 ELSE 'Invalid selection; retrying with corrective system message' END, NULL
  FROM logged WHERE verdict IN ('error', 'invalid'))
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY attempt_index, step) - 1)::INTEGER AS pos,
       attempt_index, n::INTEGER AS n_messages, validation_error::VARCHAR AS validation_error, note::VARCHAR AS note,
       attempted_code, true AS has_schema FROM entries""",
    "multi_map_filter": f"""{_CUSTOMER}
SELECT r.code AS icd9_code, r.name AS icd9_name, selected_code, more_broad_icd10_code, more_broad_icd10_name,
       closest_exact_icd10_code, closest_exact_icd10_name
FROM selections JOIN records r USING (record_id) WHERE is_multi_map""",
    "map_records": f"""{MAPPED}
SELECT r.record_id, selected_code, length(selected_name)::INTEGER AS name_length, confidence, rationale, mapping_category,
       chosen_source, num_attempts, attempted_returned_code, salvage_strategy, n_allowed, retrieved_top_k
FROM records r JOIN selections USING (record_id) LEFT JOIN lists USING (record_id) LEFT JOIN sizes USING (record_id)""",
    "map_records_audited": f"""{MAPPED},
logged AS (
  SELECT m.* FROM made m LEFT JOIN done d USING (record_id) WHERE d.attempt_index IS NULL OR m.attempt_index <= d.attempt_index)
SELECT r.record_id, count(verdict)::INTEGER AS n_entries FROM records r LEFT JOIN logged USING (record_id) GROUP BY 1""",
}
