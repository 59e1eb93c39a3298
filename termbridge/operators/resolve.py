"""From raw answers to one validated selection per record.

Answers are rows (record_id, attempt_index, raw_text), one per record and attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.operators.candidates import candidate_lists
from termbridge.operators.prompts import INVALID_CODE_NOTE, INVALID_OUTPUT_NOTE, message
from termbridge.schemas import (
    ANSWER,
    CONFIDENCE_LEVELS,
    EXTERNAL_REASONS,
    OPTIONAL_ANSWER_FIELDS,
    REQUIRED_ANSWER_FIELDS,
    SPECIFICITIES,
)

# Texts and labels that appear in result rows.
NO_MATCH_NOTE = "No confident match accepted."
EXHAUSTED_NOTE = "LLM attempts exhausted"
INVALID_CODE_ERROR = "Selected invalid code"
NOTHING_VALID = "Unable to obtain valid selection"
CORRECTED = "corrected_confidence_from_no_match_to_weak"
CORRECTED_RATIONALE = "Code selected but with low confidence due to contradictory LLM output"
MULTI_MAP_FIELDS = [
    "is_multi_map",
    "more_broad_icd10_code",
    "more_broad_icd10_name",
    "closest_exact_icd10_code",
    "closest_exact_icd10_name",
]


def parse_response(responses: DataFrame) -> DataFrame:
    """Add the answer's fields and ``error``, null for a usable answer.

    An answer must be a JSON object with all required fields and no unknown one;
    the values themselves are not checked. An empty answer counts as ``{}``. Of a repeated key the last value counts.
    """
    text = F.coalesce(F.nullif("raw_text", F.lit("")), F.lit("{}"))
    keys = F.json_object_keys(text)
    allowed = F.array(*map(F.lit, REQUIRED_ANSWER_FIELDS + OPTIONAL_ANSWER_FIELDS))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED_ANSWER_FIELDS)), F.col("keys"))
    unknown = F.array_except(F.col("keys"), allowed)
    error = (
        F.when(~F.col("is_json"), F.lit("Invalid JSON returned"))
        .when(F.col("keys").isNull(), F.lit("Schema validation failed: not an object"))
        .when(F.size(unknown) > 0, F.concat(F.lit("Schema validation failed: unknown "), F.array_join(unknown, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("Schema validation failed: missing "), F.array_join(missing, ", ")))
    )
    read = responses.withColumns(
        {
            # The strict parser refuses repeated keys; the one for maps takes the last.
            "is_json": F.try_parse_json(text).isNotNull()
            | ((F.size(keys) > F.size(F.array_distinct(keys))) & F.from_json(text, "map<string,string>").isNotNull()),
            "keys": keys,
            "answer": F.from_json(text, ANSWER),
        }
    ).withColumn("error", error)
    fields = [
        F.when(F.col("error").isNull(), F.col(f"answer.{f}")).alias(f)
        for f in REQUIRED_ANSWER_FIELDS + OPTIONAL_ANSWER_FIELDS
        if f != "is_multi_map"
    ]
    multi = F.coalesce(F.when(F.col("error").isNull(), F.col("answer.is_multi_map")), F.lit(False))
    return read.select(*responses.columns, "error", *fields, multi.alias("is_multi_map"))


def answer_violations(parsed: DataFrame) -> DataFrame:
    """Add the fields whose value is outside its fixed list; they pass through unchanged."""
    allowed = {
        "confidence": CONFIDENCE_LEVELS,
        "match_specificity": SPECIFICITIES,
        "external_choice_reason": EXTERNAL_REASONS,
    }
    found = [F.when(~F.col(f).isin(v), F.lit(f)) for f, v in allowed.items()]
    return parsed.withColumn("violations", F.array_compact(F.array(*found)))


def validate_attempt(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add ``verdict``, and the chosen candidate's name and source.

    valid: the code is a candidate, direct or known to the universe; no_match: no
    valid code but an honest no_confident_match; error: unusable answer; else invalid.
    """
    listed = candidates.select(
        "record_id",
        F.col("code").alias("best_match_icd10_code"),
        F.col("name").alias("candidate_name"),
        F.col("source").alias("candidate_source"),
        F.col("in_universe").alias("candidate_known"),
    )
    joined = parsed.join(listed, ["record_id", "best_match_icd10_code"], "left")
    usable = (F.col("candidate_source") == "direct") | F.col("candidate_known")
    verdict = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.coalesce(usable, F.lit(False)), "valid")
        .when(F.col("confidence") == "no_confident_match", "no_match")
        .otherwise("invalid")
    )
    return joined.select(
        *[c for c in parsed.columns],
        "candidate_name",
        "candidate_source",
        verdict.alias("verdict"),
    )


def first_terminal_attempt(verdicts: DataFrame, max_attempts: int = 2) -> DataFrame:
    """One row per record: its first valid or no_match attempt, if any (``terminal``),
    and the last code, name and error seen among the attempts made."""
    made = verdicts.filter(F.col("attempt_index") < max_attempts)
    done = F.col("verdict").isin("valid", "no_match")
    at = F.col("attempt_index")
    kept = [
        "attempt_index",
        "verdict",
        *REQUIRED_ANSWER_FIELDS,
        *OPTIONAL_ANSWER_FIELDS,
        "candidate_name",
        "candidate_source",
    ]
    attempted = F.struct(
        F.col("best_match_icd10_code").alias("code"), F.col("best_match_icd10_name").alias("name")
    )
    reason = F.coalesce("error", F.lit(INVALID_CODE_ERROR))
    return made.groupBy("record_id").agg(
        F.min_by(F.when(done, F.struct(*kept)), F.when(done, at)).alias("terminal"),
        F.max_by(
            F.when(F.col("verdict") != "error", attempted), F.when(F.col("verdict") != "error", at)
        ).alias("last_attempted"),
        F.max_by(F.when(~done, reason), F.when(~done, at)).alias("last_error"),
    )


def _is_direct(code: Column) -> Column:
    return F.coalesce(F.exists("direct_candidates", lambda d: d["code"] == code), F.lit(False))


def finalise_selection(terminals: DataFrame, records: DataFrame) -> DataFrame:
    """Selections of the records that reached a valid or no_match attempt."""
    t = F.col("terminal")
    joined = terminals.filter(t.isNotNull()).join(
        records.select("record_id", "direct_candidates"), "record_id"
    )
    valid = t["verdict"] == "valid"
    code = F.when(valid, t["best_match_icd10_code"])
    contradictory = valid & (t["confidence"] == "no_confident_match")
    contradictory = F.coalesce(contradictory, F.lit(False))
    rationale = t["rationale"]
    blames = F.contains(F.lower(rationale), F.lit("invalid")) | F.contains(
        F.lower(rationale), F.lit("error")
    )
    note = F.concat(
        F.lit("LLM returned valid code '"),
        code,
        F.lit("' but with contradictory 'no_confident_match' confidence. Corrected to 'weak'. Original rationale: '"),
        F.coalesce(rationale, F.lit("None")),
        F.lit("'"),
    )
    return joined.select(
        "record_id",
        code.alias("selected_code"),
        F.when(valid, t["candidate_name"]).alias("selected_name"),
        F.when(contradictory, "weak").otherwise(t["confidence"]).alias("confidence"),
        F.when(contradictory & blames, CORRECTED_RATIONALE).otherwise(rationale).alias("rationale"),
        F.when(~valid, "NONE")
        .when(_is_direct(code), "DIRECT_MATCH")
        .otherwise("OTHER_MATCH")
        .alias("mapping_category"),
        t["match_specificity"].alias("match_specificity"),
        F.when(valid, t["external_choice_reason"]).otherwise("N/A").alias("external_choice_reason"),
        F.when(valid, t["candidate_source"]).alias("chosen_source"),
        F.when(contradictory, note).when(~valid, NO_MATCH_NOTE).alias("validator_notes"),
        (t["attempt_index"] + 1).cast("int").alias("num_attempts"),
        t["best_match_icd10_code"].alias("attempted_returned_code"),
        t["best_match_icd10_name"].alias("attempted_returned_name"),
        F.when(contradictory, CORRECTED).alias("salvage_strategy"),
        F.when(valid, t["is_multi_map"]).otherwise(F.lit(False)).alias("is_multi_map"),
        *[F.when(valid, t[f]).alias(f) for f in MULTI_MAP_FIELDS[1:]],
    )


def canonical_multi_map(selections: DataFrame, universe: DataFrame) -> DataFrame:
    """Names of the broad and exact codes from the universe, where it knows the code.

    The codes are rarely set, so both are looked up in one join of the set ones.
    """
    names = universe.select(F.col("code").cast("string").alias("code"), F.col("name").alias("known"))
    sides = {"broad": "more_broad_icd10", "exact": "closest_exact_icd10"}
    wanted = selections.select(
        "record_id",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{p}_code").alias("code")) for s, p in sides.items()])
        ).alias("w"),
    ).select("record_id", "w.side", "w.code")
    found = (
        wanted.filter(F.col("code").isNotNull())
        .join(names, "code")
        .groupBy("record_id")
        .agg(*[F.max(F.when(F.col("side") == s, F.col("known"))).alias(f"known_{s}") for s in sides])
    )
    renamed = {
        f"{p}_name": F.coalesce(F.col(f"known_{s}"), F.col(f"{p}_name")) for s, p in sides.items()
    }
    return (
        selections.join(found, "record_id", "left").withColumns(renamed).select(*selections.columns)
    )


def salvage(
    records: DataFrame, terminals: DataFrame, candidates: DataFrame, max_attempts: int = 2
) -> DataFrame:
    """Selections of the records without a terminal attempt.

    In order: the last attempted code if it is a candidate, the first direct
    candidate given as "unspecified", the first direct one, the best retrieved
    one, nothing.
    """
    open_records = (
        records.select("record_id", "direct_candidates")
        .join(terminals, "record_id", "left")
        .filter(F.col("terminal").isNull())
    )
    lists = candidates.groupBy("record_id").agg(
        F.map_from_entries(F.collect_list(F.struct("code", F.struct("name", "in_universe")))).alias("by_code"),
        F.min_by(
            F.when(F.col("source") == "retrieved", F.struct("code", "name")),
            F.when(F.col("source") == "retrieved", F.struct(-F.coalesce("score", F.lit(0.0)), F.col("pos"))),
        ).alias("top_retrieved"),
    )
    joined = open_records.join(lists, "record_id", "left")
    directs = F.coalesce("direct_candidates", F.array().cast("array<struct<code:string,name:string>>"))
    given = F.filter(
        directs, lambda d: F.contains(F.lower(F.coalesce(d["name"], F.lit(""))), F.lit("unspecified"))
    )
    attempted = F.col("last_attempted.code")
    attempted_in = F.try_element_at("by_code", attempted)
    preferred, first = F.get(given, F.lit(0)), F.get(directs, F.lit(0))
    direct = F.coalesce(preferred, first)
    direct_known = F.try_element_at("by_code", direct["code"])
    use_attempted = F.coalesce(attempted, F.lit("")) != ""
    use_attempted = use_attempted & attempted_in.isNotNull()
    use_direct = F.size(directs) > 0
    code = (
        F.when(use_attempted, attempted)
        .when(use_direct, direct["code"])
        .otherwise(F.col("top_retrieved.code"))
    )
    name = (
        F.when(use_attempted, attempted_in["name"])
        .when(use_direct, F.when(direct_known["in_universe"], direct_known["name"]).otherwise(direct["name"]))
        .otherwise(F.col("top_retrieved.name"))
    )
    chosen = F.col("selected_code")
    picked = joined.select(
        "record_id",
        "direct_candidates",
        code.alias("selected_code"),
        name.alias("selected_name"),
        F.coalesce("last_error", F.lit(NOTHING_VALID)).alias("rationale"),
        attempted.alias("attempted_returned_code"),
        F.col("last_attempted.name").alias("attempted_returned_name"),
        given.alias("given"),
    )
    strategy = (
        F.when(chosen.isNull(), "none")
        .when(chosen == F.col("attempted_returned_code"), "attempted_code")
        .when(F.exists("given", lambda d: d["code"] == chosen), "direct_unspecified")
        .when(_is_direct(chosen), "direct_first")
        .otherwise("retrieved_top")
    )
    text = F.lit(None).cast("string")
    return picked.select(
        "record_id",
        "selected_code",
        "selected_name",
        F.lit("no_confident_match").alias("confidence"),
        "rationale",
        F.when(chosen.isNull(), "NONE")
        .when(_is_direct(chosen), "DIRECT_MATCH")
        .otherwise("OTHER_MATCH")
        .alias("mapping_category"),
        F.lit("MORE_BROAD").alias("match_specificity"),
        F.lit("N/A").alias("external_choice_reason"),
        F.when(chosen.isNull(), text)
        .when(_is_direct(chosen), "direct")
        .otherwise("retrieved")
        .alias("chosen_source"),
        F.lit(EXHAUSTED_NOTE).alias("validator_notes"),
        F.lit(max_attempts).alias("num_attempts"),
        "attempted_returned_code",
        "attempted_returned_name",
        strategy.alias("salvage_strategy"),
        F.lit(False).alias("is_multi_map"),
        *[text.alias(f) for f in MULTI_MAP_FIELDS[1:]],
    )


def attempt_audit(
    verdicts: DataFrame, asked: DataFrame, schemas: DataFrame, max_attempts: int = 2
) -> DataFrame:
    """Per record the log of the attempts made: messages, raw answer, error and note.

    ``asked`` has the messages of every attempt. A usable answer gives one entry;
    a failed attempt gives one with the corrective line added. Everything meets under the
    record alone, so messages and schemas are not shuffled again for each step.
    """
    answer = ["attempt_index", "verdict", "raw_text", "error", "best_match_icd10_code", "best_match_icd10_name"]
    judged = (
        verdicts.filter(F.col("attempt_index") < max_attempts)
        .groupBy("record_id")
        .agg(
            F.collect_list(F.struct(*answer)).alias("made"),
            F.min(F.when(F.col("verdict").isin("valid", "no_match"), F.col("attempt_index"))).alias("ended"),
        )
    )
    text = F.lit(None).cast("string")
    is_error = F.col("verdict") == "error"

    def entry(step: int, messages: Column, answered: bool, error: Column, note: Column) -> Column:
        return F.struct(
            "attempt_index",
            F.lit(step).alias("step"),
            messages.alias("messages"),
            F.col("schema_json").alias("json_schema"),
            (F.col("raw_text") if answered else text).alias("raw_response_text"),
            (F.col("raw_text") if answered else text).alias("raw_response_object"),
            error.alias("validation_error"),
            note.alias("note"),
            (F.col("best_match_icd10_code") if answered else text).alias("attempted_code"),
            (F.col("best_match_icd10_name") if answered else text).alias("attempted_name"),
        )

    def corrected(line: str) -> Column:
        return F.concat("messages", F.array(message("system", F.lit(line))))

    answered = F.when(~is_error, entry(0, F.col("messages"), True, text, text))
    failed = F.when(
        is_error,
        entry(1, corrected(INVALID_OUTPUT_NOTE), False, F.col("error"), F.lit("Validation error; added corrective system message")),
    ).when(
        F.col("verdict") == "invalid",
        entry(1, corrected(INVALID_CODE_NOTE), False, F.lit(INVALID_CODE_ERROR), F.lit("Invalid selection; retrying with corrective system message")),
    )
    together = asked.withColumnRenamed("attempt_index", "at").join(judged, "record_id").join(schemas, "record_id")
    here = F.filter(
        "made", lambda m: (m["attempt_index"] == F.col("at")) & (F.col("ended").isNull() | (m["attempt_index"] <= F.col("ended")))
    )
    rows = together.withColumn("m", F.explode(here)).select("record_id", "messages", "schema_json", "m.*")
    entries = rows.select("record_id", F.explode(F.array_compact(F.array(answered, failed))).alias("e"))
    logs = entries.groupBy("record_id").agg(F.array_sort(F.collect_list("e")).alias("log"))
    return logs.select("record_id", F.transform("log", lambda e: e.dropFields("step")).alias("attempts"))


def assemble_result(
    records: DataFrame,
    selections: DataFrame,
    candidates: DataFrame,
    retrieved: DataFrame,
    audits: DataFrame | None = None,
) -> DataFrame:
    """One nested row of 21 fields per record, with ``audit`` beside it."""
    sizes = retrieved.groupBy("record_id").agg(F.count(F.lit(1)).cast("int").alias("retrieved_top_k"))
    lists = candidate_lists(candidates)
    joined = (
        records.join(selections, "record_id")
        .join(lists, "record_id", "left")
        .join(sizes, "record_id", "left")
    )
    if audits is not None:
        joined = joined.join(audits, "record_id", "left")
        audit = F.struct("allowed_candidates", F.coalesce("attempts", F.array().cast(audits.schema["attempts"].dataType)).alias("attempts"))
    none = F.array().cast("array<struct<code:string,name:string,source:string,score:double>>")
    result = joined.withColumn("allowed_candidates", F.coalesce("allowed_candidates", none)).select(
        "record_id",
        F.struct(
            F.col("code").alias("icd9_code"), F.col("name").alias("icd9_name"), "direct_candidates"
        ).alias("input"),
        "selected_code",
        "selected_name",
        "confidence",
        "rationale",
        "mapping_category",
        "match_specificity",
        "external_choice_reason",
        "chosen_source",
        "allowed_candidates",
        F.coalesce("retrieved_top_k", F.lit(0)).alias("retrieved_top_k"),
        "validator_notes",
        "num_attempts",
        "attempted_returned_code",
        "attempted_returned_name",
        "salvage_strategy",
        *MULTI_MAP_FIELDS,
        *([audit.alias("audit")] if audits is not None else []),
    )
    return result
