import json

import pytest
from pyspark.sql import functions as F

from termbridge.operators import compare, prompts, resolve
from termbridge.plans import mapping
from termbridge.schemas import CANDIDATES, MapperConfig


def answer(code="B", confidence="strong", **other):
    fields = {
        "best_match_icd10_code": code,
        "best_match_icd10_name": "said",
        "confidence": confidence,
        "rationale": "fits",
        "mapping_category": "NONE",
        "match_specificity": "EXACT",
        "external_choice_reason": "N/A",
    }
    fields.update(other)
    return json.dumps({k: v for k, v in fields.items() if v != "drop"})


RECORDS = [
    (1, "001", "valid direct", [("A", "given a"), ("X", "side unspecified")]),
    (2, "002", "valid retrieved", []),
    (3, "003", "null code, then valid", []),
    (4, "004", "honest no match", []),
    (5, "005", "invented code, no match", []),
    (6, "006", "valid but no confidence", []),
    (7, "007", "all bad with unspecified", [("A", "given a"), ("X", "Side UNSPECIFIED")]),
    (8, "008", "all bad, direct", [("Y", None), ("A", "given a")]),
    (9, "009", "all bad, retrieved only", []),
    (10, "010", "never answered, nothing", []),
    (11, "011", "bad then good", []),
    (12, "012", "third attempt too late", []),
    (13, "013", "multi map", []),
]
ANSWERS = [
    (1, 0, answer("A")),
    (2, 0, answer("B")),
    (2, 1, answer("C")),
    (3, 0, answer(None)),
    (3, 1, answer("C")),
    (4, 0, answer(None, "no_confident_match")),
    (5, 0, answer("Q99", "no_confident_match")),
    (6, 0, answer("B", "no_confident_match", rationale="An Error happened")),
    (7, 0, "not json"),
    (7, 1, answer("Q99")),
    (8, 0, answer("B", confidence="drop")),
    (8, 1, answer("B", extra=1)),
    (9, 0, answer("Q1")),
    (9, 1, "[1]"),
    (11, 0, ""),
    (11, 1, answer("B")),
    (12, 0, answer("Q1")),
    (12, 1, answer("Q2")),
    (12, 2, answer("B")),
    (13, 0, answer("B", is_multi_map=True, more_broad_icd10_code="C", more_broad_icd10_name="said c",
                   closest_exact_icd10_code="unknown", closest_exact_icd10_name="said u")),
]


@pytest.fixture(scope="module")
def tables(spark):
    records = spark.createDataFrame(
        RECORDS,
        "record_id int, code string, name string, direct_candidates array<struct<code:string,name:string>>",
    )
    universe = spark.createDataFrame(
        [("A", "Name A"), ("B", "Name B"), ("C", "Name C")], "code string, name string"
    )
    found = [(i, "C", 0.9, 1) for i, *_ in RECORDS if i != 10]
    found += [(i, "B", 0.5, 2) for i, *_ in RECORDS if i != 10]
    retrieved = spark.createDataFrame(found, "record_id int, code string, score double, rank int")
    responses = spark.createDataFrame(ANSWERS, "record_id int, attempt_index int, raw_text string")
    return records, universe, retrieved, responses


@pytest.fixture(scope="module")
def steps(tables):
    from termbridge.operators.candidates import merge_candidates

    records, universe, retrieved, responses = tables
    candidates = merge_candidates(records, retrieved, universe)
    verdicts = resolve.validate_attempt(resolve.parse_response(responses), candidates)
    return candidates, verdicts, resolve.first_terminal_attempt(verdicts)


@pytest.fixture(scope="module")
def results(tables, steps):
    records, universe, retrieved, _ = tables
    candidates, verdicts, terminals = steps
    selections = resolve.canonical_multi_map(
        resolve.finalise_selection(terminals, records), universe
    ).unionByName(resolve.salvage(records, terminals, candidates))
    rows = resolve.assemble_result(records, selections, candidates, retrieved)
    return {r.record_id: r for r in rows.collect()}


def test_errors(spark):
    texts = ["no", "[1]", "3", "{}", "", None, answer(), answer(extra=1), answer(rationale="drop"), answer(is_multi_map=None)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "record_id int, attempt_index int, raw_text string")
    errors = [r.error for r in resolve.parse_response(df).orderBy("record_id").collect()]
    assert errors[0] == "Invalid JSON returned" and errors[6] is None and errors[9] is None
    assert errors[1] == errors[2] == "Schema validation failed: not an object"
    assert errors[3] == errors[4] == errors[5] and "missing best_match_icd10_code" in errors[3]
    assert errors[7].endswith("unknown extra") and errors[8].endswith("missing rationale")


def test_verdicts(steps):
    verdicts = {(r.record_id, r.attempt_index): r.verdict for r in steps[1].collect()}
    assert verdicts[1, 0] == "valid" and verdicts[3, 0] == "invalid" and verdicts[4, 0] == "no_match"
    assert verdicts[5, 0] == "no_match" and verdicts[6, 0] == "valid" and verdicts[7, 0] == "error"
    assert verdicts[9, 0] == "invalid" and verdicts[9, 1] == "error"


def test_one_result_per_record(results):
    assert sorted(results) == [r[0] for r in RECORDS]


def test_accepted(results):
    r = results[1]
    assert (r.selected_code, r.selected_name, r.mapping_category, r.chosen_source) == ("A", "Name A", "DIRECT_MATCH", "direct")
    assert r.num_attempts == 1 and r.salvage_strategy is None and r.retrieved_top_k == 2
    r = results[2]
    assert (r.selected_code, r.mapping_category, r.chosen_source, r.attempted_returned_code) == ("B", "OTHER_MATCH", "retrieved", "B")
    assert (results[3].selected_code, results[3].num_attempts) == ("C", 2)
    assert (results[11].selected_code, results[11].num_attempts) == ("B", 2)


def test_no_match(results):
    for i, attempted in ((4, None), (5, "Q99")):
        r = results[i]
        assert r.selected_code is None and r.mapping_category == "NONE"
        assert r.confidence == "no_confident_match" and r.validator_notes == "No confident match accepted."
        assert r.attempted_returned_code == attempted and r.chosen_source is None


def test_contradiction_is_weak(results):
    r = results[6]
    assert (r.selected_code, r.confidence) == ("B", "weak")
    assert r.salvage_strategy == "corrected_confidence_from_no_match_to_weak"
    assert r.rationale == "Code selected but with low confidence due to contradictory LLM output"
    assert "Original rationale: 'An Error happened'" in r.validator_notes


def test_salvage(results):
    r = results[7]
    assert (r.selected_code, r.selected_name, r.salvage_strategy) == ("X", "Side UNSPECIFIED", "direct_unspecified")
    assert (r.confidence, r.match_specificity, r.rationale) == ("no_confident_match", "MORE_BROAD", "Selected invalid code")
    assert r.validator_notes == "LLM attempts exhausted" and r.num_attempts == 2
    r = results[8]
    assert (r.selected_code, r.selected_name, r.salvage_strategy, r.chosen_source) == ("Y", None, "direct_first", "direct")
    assert r.rationale == "Schema validation failed: unknown extra"
    r = results[9]
    assert (r.selected_code, r.salvage_strategy, r.mapping_category) == ("C", "retrieved_top", "OTHER_MATCH")
    assert r.attempted_returned_code == "Q1" and "not an object" in r.rationale
    r = results[10]
    assert (r.selected_code, r.salvage_strategy, r.mapping_category) == (None, "none", "NONE")
    assert r.rationale == "Unable to obtain valid selection" and r.allowed_candidates == []
    assert results[12].salvage_strategy == "retrieved_top" and results[12].attempted_returned_code == "Q2"


def test_salvage_prefers_an_attempted_candidate(spark, tables, steps):
    records = tables[0].filter("record_id = 7")
    terminals = records.select(
        "record_id",
        F.lit(None).cast("struct<verdict:string>").alias("terminal"),
        F.struct(F.lit("A").alias("code"), F.lit("said").alias("name")).alias("last_attempted"),
        F.lit("late").alias("last_error"),
    )
    row = resolve.salvage(records, terminals, steps[0]).first()
    assert (row.selected_code, row.selected_name, row.salvage_strategy) == ("A", "Name A", "attempted_code")


def test_multi_map_names(results):
    r = results[13]
    assert r.is_multi_map and (r.more_broad_icd10_code, r.more_broad_icd10_name) == ("C", "Name C")
    assert (r.closest_exact_icd10_code, r.closest_exact_icd10_name) == ("unknown", "said u")


def test_prompts(tables, steps):
    records, *_ = tables
    blocks = {r.record_id: r for r in prompts.candidate_block(records, steps[0]).collect()}
    assert blocks[10].candidate_block == "(none)" and blocks[1].direct_codes == ["A", "X"]
    assert blocks[2].candidate_block.split("\n") == [
        "- C: Name C [source=retrieved, score=0.900]",
        "- B: Name B [source=retrieved, score=0.500]",
    ]
    schema = json.loads(prompts.response_schema(records, steps[0]).filter("record_id = 1").first().schema_json)
    code = schema["schema"]["properties"]["best_match_icd10_code"]["anyOf"]
    assert code == [{"type": "string", "enum": ["A", "B", "C", "X"]}, {"type": "null"}]
    assert "is_multi_map" in schema["schema"]["required"] and schema["strict"] is True
    messages = prompts.synonym_prompts(records).first().messages
    assert [m.role for m in messages] == ["system", "user"]


def test_three_digits_like_exact_rounding(spark):
    values = [0.8885, 0.0625, 0.1875, 0.3125, 0.12349999, 0.9995, 1.0, 0.0, -0.0625, 0.5005, 1.9995]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(prompts.three_digits(F.col("x"))).collect()]
    assert got == [f"{v:.3f}" for v in values]


def test_corrections_and_audit(tables, steps):
    records = tables[0]
    candidates, verdicts, _ = steps
    asked = prompts.corrective_messages(verdicts, prompts.selection_prompts(records, candidates))
    by_attempt = {(r.record_id, r.attempt_index): r.messages for r in asked.collect()}
    assert len(by_attempt[7, 0]) == 2 and by_attempt[7, 1][-1].content == prompts.INVALID_OUTPUT_NOTE
    assert by_attempt[9, 1][-1].content == prompts.INVALID_CODE_NOTE
    assert (12, 2) not in by_attempt
    base = prompts.selection_prompts(records, candidates)
    ahead = {r.record_id: r for r in prompts.next_attempt_messages(base, verdicts, 3).collect()}
    settled = {r.record_id for r in verdicts.filter("verdict IN ('valid', 'no_match') AND attempt_index < 3").collect()}
    assert not settled & set(ahead) and ahead[9].attempt_index == 2
    assert [m.content for m in ahead[9].messages[2:]] == [prompts.INVALID_CODE_NOTE, prompts.INVALID_OUTPUT_NOTE]
    fresh = {r.record_id: r for r in prompts.next_attempt_messages(base, verdicts.limit(0)).collect()}
    assert len(fresh) == records.count() and all(r.attempt_index == 0 and len(r.messages) == 2 for r in fresh.values())
    schemas = prompts.response_schema(records, candidates)
    logs = {r.record_id: r.attempts for r in resolve.attempt_audit(verdicts, asked, schemas).collect()}
    assert len(logs[2]) == 1  # the second answer came after an accepted one
    assert [(e.attempt_index, e.attempted_code, e.validation_error) for e in logs[9]] == [
        (0, "Q1", None),
        (0, None, "Selected invalid code"),
        (1, None, "Schema validation failed: not an object"),
    ]
    assert [len(e.messages) for e in logs[9]] == [2, 3, 4]


def test_whole_job(spark, tables):
    universe = tables[1].withColumns(
        {"synonyms": F.array().cast("array<string>"), "description": F.lit(None).cast("string")}
    )
    model, embedded = mapping.embed_universe(universe, 64)
    records = tables[0].withColumn("direct_candidates", F.col("direct_candidates").cast(CANDIDATES))
    config = MapperConfig(retrieve_top_k=2, audit=True)
    whole = mapping.map_records(records, embedded, model, tables[3], config)
    assert len([c for c in whole.columns if c not in ("record_id", "audit")]) == 21
    rows = {r.record_id: r for r in whole.collect()}
    assert len(rows) == 13 and rows[1].selected_code == "A"
    assert all(r.retrieved_top_k == 2 for r in rows.values())
    prepared = mapping.prepare(records, embedded, model, config, rules="OWN RULES")
    again = mapping.resolve_prepared(prepared, tables[3], embedded)
    same = ["record_id", "selected_code", "num_attempts"]
    assert sorted(again.select(same).collect()) == sorted(whole.select(same).collect())
    logged = again.select(F.explode("audit.attempts").alias("e")).select("e.messages").collect()
    assert {r.messages[0].content for r in logged if r.messages} == {"OWN RULES"}
    asked = {r.record_id for r in mapping.next_round(prepared, tables[3].filter("attempt_index = 0")).collect()}
    assert 9 in asked and 1 not in asked
    expanded = mapping.map_records(
        records, embedded, model, tables[3], MapperConfig(synonym_expansion=True, synonym_top_k=1)
    )
    assert expanded.count() == 13


def test_comparison(spark):
    schema = "icd9_code string, icd9_name string, selected_code string, selected_name string, confidence string"
    a = spark.createDataFrame(
        [(" 099", "n", "B99", "b", "weak"), ("1", "n", None, None, "weak"), ("2", "n", "A", "a", "strong"),
         ("3", "n", "A", "a", "medium"), ("4", "n", "A", "a", "medium"), ("5", "n", "A", "a", "medium")],
        schema,
    )
    b = spark.createDataFrame(
        [("099 ", "n", "A64", "b", "strong"), ("1", "n", None, None, "weak"), ("2", "n", None, "a", "weak"),
         ("3", "n", "A", "a", "strong"), ("4", "n", "C", "a", "medium"), ("9", "n", "C", "a", "medium")],
        schema,
    )
    joined = compare.compare_join(a, b)
    copies = compare.compare_join(a.union(a), b.union(b).union(b))
    assert copies.count() == joined.count()
    row = compare.compare_summary(copies).first()
    assert (row.n_joined, row.n_different, row.n_regression) == (30, 18, 6)
    changes = {r.icd9_code: r.change for r in compare.compare_diff(joined).collect()}
    assert changes == {"099": "improvement", "2": "regression", "4": "same"}
    row = compare.compare_summary(joined).first()
    assert (row.n_joined, row.n_different, row.percent_different) == (5, 3, 60.0)
    assert compare.compare_summary(joined.filter("icd9_code = 'x'")).first().percent_different is None
    outcomes = [compare.case_check(joined, c, e).first().outcome for c, e in
                [("099", "A64"), ("099", "B99"), ("099", "Z"), ("77", "A64")]]
    assert outcomes == ["found_by_second", "already_in_first", "neither", "not_in_set"]
    first = compare.confidence_distribution(joined).first()
    assert (first.run, first.confidence, first.n) == ("baseline", "medium", 2)


def test_the_last_of_a_repeated_key_counts(spark):
    first, last = answer("A"), answer("B")
    texts = [first[:-1] + ", " + last[1:], first[:-1] + ", " + last, "{" + '"x": 1, "x": 2}']
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "record_id int, attempt_index int, raw_text string")
    rows = resolve.parse_response(df).orderBy("record_id").collect()
    assert (rows[0].error, rows[0].best_match_icd10_code) == (None, "B")
    assert rows[1].error == "Invalid JSON returned" and rows[2].error.startswith("Schema validation failed: unknown x")


def test_stage_judges_only_the_attempts_a_job_looks_at(spark, sf_dir):
    """Every later answer was parsed and judged too, though no result can depend on it."""
    from termbridge.catalog import resolve_queries as rq

    made = rq.responses(spark, sf_dir, 2)
    everything = rq.responses(spark, sf_dir).filter("attempt_index < 2")
    assert made.count() == everything.count() and made.exceptAll(everything).isEmpty()
    assert rq.Stage(spark, sf_dir).verdicts.filter("attempt_index >= 2").isEmpty()


def test_audit_shuffles_prompts_under_the_record_only(spark, tables, steps):
    """Messages were shuffled by record and attempt, and once more with the schemas by record."""
    candidates, verdicts, _ = steps
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = prompts.corrective_messages(verdicts, prompts.selection_prompts(tables[0], candidates))
        logs = resolve.attempt_audit(verdicts, asked, prompts.response_schema(tables[0], candidates))
        plan = logs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = [x.split("Exchange hashpartitioning(")[1].split(")")[0] for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
    assert dealt and not [x for x in dealt if "attempt_index" in x]
