"""Tables of prompts and answer schemas for a batch model run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.schemas import (
    CONFIDENCE_LEVELS,
    EXTERNAL_REASONS,
    MAPPING_CATEGORIES,
    REQUIRED_ANSWER_FIELDS,
    SPECIFICITIES,
)

SELECTION_RULES = """\
Choose the target code that best matches the source term. Pick only from ALLOWED_CANDIDATES and copy codes exactly.
Prefer a DIRECT candidate that fits. Without an exact match, a broader code that covers the whole term beats a narrower one.
If a side of the body is not stated, prefer the code for the unspecified side.
If the term joins several separate conditions, set is_multi_map to true, choose the broader code that covers them all, repeat it in the more_broad fields, and name the most relevant specific code in the closest_exact fields. Otherwise leave those fields null.
Set confidence to strong, medium or weak; only when nothing fits, set the best_match fields to null and confidence to no_confident_match.
Set mapping_category to DIRECT_MATCH, OTHER_MATCH or NONE, and match_specificity to EXACT, CLOSE or MORE_BROAD.
If you pass over existing DIRECT candidates, set external_choice_reason to MULTIMAP or BAD_MAPPING, else to N/A.
Give a rationale of one to three sentences. Answer with one JSON object of the given schema and nothing else."""

SYNONYM_RULES = """\
List other names clinicians use for the diagnosis: synonyms, common abbreviations, formal and informal wordings.
Give at most six that mean the same, without the original. Answer with a JSON object {"synonyms": [...]}."""

INVALID_OUTPUT_NOTE = (
    "The last answer could not be read. Give one valid JSON object with a code from"
    " ALLOWED_CANDIDATES, or null best_match fields and no_confident_match."
)
INVALID_CODE_NOTE = (
    "The last answer chose a code outside ALLOWED_CANDIDATES. Choose one code from that list only."
)

ROLE_AND_CONTENT = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def three_digits(x: Column) -> Column:
    """``x`` (below 2 in size) with three decimals, rounded from its exact binary value.

    ``x`` is split into two parts whose multiples are exact, so the comparison with
    the middle between two candidates is exact too; a true tie goes to the even one.
    """
    below = F.floor(x * 1000.0)
    high = F.floor(x * 1048576.0) / 1048576.0
    to_middle = (2.0 * below + 1.0) - 2000.0 * high - 2000.0 * (x - high)
    up = (to_middle < 0) | ((to_middle == 0) & (F.pmod(below, F.lit(2)) == 1))
    return F.format_string("%.3f", (below + F.when(up, 1).otherwise(0)) / 1000.0)


def candidate_line() -> Column:
    """``- code: name [source=s, score=0.123]``; the score only where there is one."""
    shown = F.when(
        F.abs("score") < 2.0, three_digits(F.col("score"))
    ).otherwise(F.format_string("%.3f", "score"))
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit(", score="), shown))
    return F.concat(
        F.lit("- "),
        F.col("code"),
        F.lit(": "),
        F.replace(F.col("name"), F.lit("\n"), F.lit(" ")),
        F.lit(" [source="),
        F.col("source"),
        F.coalesce(score, F.lit("")),
        F.lit("]"),
    )


def candidate_block(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per record the lines of its candidates in order, ``(none)`` without any,
    and the sorted direct codes."""
    lines = candidates.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", candidate_line().alias("line")))).alias("lines"),
        F.array_sort(F.collect_set(F.when(F.col("source") == "direct", F.col("code")))).alias(
            "direct_codes"
        ),
    )
    block = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return (
        records.select("record_id")
        .join(lines, "record_id", "left")
        .select(
            "record_id",
            F.coalesce(block, F.lit("(none)")).alias("candidate_block"),
            F.coalesce("direct_codes", F.array().cast("array<string>")).alias("direct_codes"),
        )
    )


def selection_prompts(
    records: DataFrame, candidates: DataFrame, rules: str = SELECTION_RULES
) -> DataFrame:
    """(record_id, messages): the rules, then the record with its candidates."""
    text = F.concat(
        F.lit("Source term\ncode: "),
        F.col("code"),
        F.lit("\nname: "),
        F.col("name"),
        F.lit("\n\nALLOWED_CANDIDATES\n"),
        F.col("candidate_block"),
        F.lit("\n\nDIRECT codes: ["),
        F.array_join("direct_codes", ", "),
        F.lit("]\nChoose one code from ALLOWED_CANDIDATES, or none."),
    )
    blocks = candidate_block(records, candidates)
    return records.join(blocks, "record_id").select(
        "record_id",
        F.array(message("system", F.lit(rules)), message("user", text)).alias("messages"),
    )


def response_schema(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_id, schema_json): the JSON schema an answer must follow."""

    def words(values: list[str]) -> Column:
        return F.struct(
            F.lit("string").alias("type"), F.array(*map(F.lit, values)).alias("enum")
        )

    codes = F.struct(
        F.array(
            F.struct(F.lit("string").alias("type"), F.col("codes").alias("enum")),
            F.struct(F.lit("null").alias("type"), F.lit(None).cast("array<string>").alias("enum")),
        ).alias("anyOf")
    )
    text_or_null = F.struct(F.array(F.lit("string"), F.lit("null")).alias("type"))
    plain = {
        "best_match_icd10_code": codes,
        "best_match_icd10_name": text_or_null,
        "confidence": words(CONFIDENCE_LEVELS),
        "rationale": F.struct(F.lit("string").alias("type")),
        "mapping_category": words(MAPPING_CATEGORIES),
        "is_multi_map": F.struct(F.lit("boolean").alias("type")),
        "match_specificity": words(SPECIFICITIES),
        "external_choice_reason": words(EXTERNAL_REASONS),
        "more_broad_icd10_code": codes,
        "more_broad_icd10_name": text_or_null,
        "closest_exact_icd10_code": codes,
        "closest_exact_icd10_name": text_or_null,
    }
    schema = F.struct(
        F.lit("object").alias("type"),
        F.lit(False).alias("additionalProperties"),
        F.struct(*[c.alias(n) for n, c in plain.items()]).alias("properties"),
        F.array(*map(F.lit, [*REQUIRED_ANSWER_FIELDS, "is_multi_map"])).alias("required"),
    )
    whole = F.struct(
        F.lit("mapping_response").alias("name"), schema.alias("schema"), F.lit(True).alias("strict")
    )
    listed = candidates.groupBy("record_id").agg(
        F.array_sort(F.collect_set("code")).alias("codes")
    )
    every = records.select("record_id").join(listed, "record_id", "left")
    none = F.array().cast("array<string>")
    return every.withColumn("codes", F.coalesce("codes", none)).select("record_id", F.to_json(whole).alias("schema_json"))


def synonym_prompts(records: DataFrame, rules: str = SYNONYM_RULES) -> DataFrame:
    """(record_id, messages) that ask for other names of each record."""
    text = F.concat(
        F.lit("Source term\ncode: "),
        F.col("code"),
        F.lit("\nname: "),
        F.col("name"),
        F.lit("\n\nList its synonyms."),
    )
    return records.select(
        "record_id",
        F.array(message("system", F.lit(rules)), message("user", text)).alias("messages"),
    )


def _correction() -> Column:
    """The line that an attempt which failed adds to the next ones."""
    return F.when(F.col("verdict") == "error", F.lit(INVALID_OUTPUT_NOTE)).when(
        F.col("verdict") == "invalid", F.lit(INVALID_CODE_NOTE)
    )


def next_attempt_messages(
    prompts: DataFrame, verdicts: DataFrame, max_attempts: int = 2
) -> DataFrame:
    """(record_id, attempt_index, messages): what the next batch run is to ask.

    Records whose answers were settled, or that have used up their attempts, are
    left out; a record without an answer is at attempt 0. One row per prompt.
    """
    history = verdicts.filter(F.col("attempt_index") < max_attempts).groupBy("record_id").agg(
        (F.max("attempt_index") + 1).alias("next"),
        F.bool_or(F.col("verdict").isin("valid", "no_match")).alias("settled"),
        F.array_sort(F.collect_list(F.struct("attempt_index", _correction().alias("note")))).alias("history"),
    )
    notes = F.filter(F.coalesce("history.note", F.array().cast("array<string>")), lambda n: n.isNotNull())
    added = F.transform(notes, lambda n: message("system", n))
    return (
        prompts.join(history, "record_id", "left")
        .withColumn("attempt_index", F.coalesce("next", F.lit(0)).cast("int"))
        .filter(~F.coalesce("settled", F.lit(False)) & (F.col("attempt_index") < max_attempts))
        .select("record_id", "attempt_index", F.concat("messages", added).alias("messages"))
    )


def corrective_messages(
    verdicts: DataFrame, prompts: DataFrame, max_attempts: int = 2
) -> DataFrame:
    """(record_id, attempt_index, messages): what each attempt was asked.

    Every earlier attempt that failed has added one line: one text after an
    answer that could not be read, another after a code that is not allowed.
    """
    note = _correction()
    asked = verdicts.filter(F.col("attempt_index") < max_attempts)
    noted = asked.select("record_id", "attempt_index", note.alias("note"))
    history = noted.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("attempt_index", "note"))).alias("history")
    )
    unrolled = history.select("record_id", "history", F.explode("history.attempt_index").alias("attempt_index"))
    added = F.transform(
        F.filter("history", lambda h: (h["attempt_index"] < F.col("attempt_index")) & h["note"].isNotNull()),
        lambda h: message("system", h["note"]),
    )
    return unrolled.join(prompts, "record_id").select(
        "record_id", "attempt_index", F.concat("messages", added).alias("messages")
    )
