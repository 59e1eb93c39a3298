"""Readers of universes, records, pairs and results. Codes are always strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termbridge.functions.text import (
    parse_pipe_candidates,
    parse_tagged_candidates,
    split_list,
    strip,
)
from termbridge.operators.skew import number_rows
from termbridge.schemas import ANSWER, PairSpec

# Column names under which a records file may hold candidates, in order.
CANDIDATE_COLUMNS = ["direct_candidates", "direct", "icd10_direct_candidates"]
# An older name of a mapping category, and the present one.
OLD_CATEGORY, PRESENT_CATEGORY = "CLOSE_MATCH", "DIRECT_MATCH"
NO_CELL = "\x00null\x00"  # what the parser gives for a cell without text or quotes


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False, keep_empty: bool = False
) -> DataFrame:
    """Files with a header, every column a string.

    ``multi_line`` allows line breaks in quoted cells; a file is then read by one
    task, so large inputs should come as several files. Empty cells are null; with
    ``keep_empty`` only those without quotes, and ``""`` is an empty text.
    """
    null = NO_CELL if keep_empty else ""
    return spark.read.csv(
        path, sep=sep, header=True, inferSchema=False, multiLine=multi_line, escape='"', nullValue=null, emptyValue=""
    )


def input_position() -> list[Column]:
    """Where a row stands in its input: file, place of its split, row within it."""
    return [
        F.col("_metadata.file_path").alias("at_file"),
        F.col("_metadata.file_block_start").alias("at_block"),
        F.monotonically_increasing_id().alias("at_row"),
    ]


def _text(df: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`") if name and name in df.columns else F.lit(None).cast("string")


def _universe(df: DataFrame, code: str, name: str, synonyms: str | None, description: str | None):
    for column in (code, name):
        if column not in df.columns:
            raise ValueError(f"the universe has no column {column!r}")
    rows = df.select(
        strip(_text(df, code)).alias("code"),
        strip(F.coalesce(_text(df, name), F.lit(""))).alias("name"),
        split_list(_text(df, synonyms)).alias("synonyms"),
        _text(df, description).alias("description"),
        F.struct(*input_position()).alias("at"),
    ).filter(F.col("code").isNotNull())
    last = F.max_by(F.struct("name", "synonyms", "description"), "at").alias("e")
    return rows.groupBy("code").agg(last, F.count(F.lit(1)).alias("n_rows")).select(
        "code", "e.name", "e.synonyms", "e.description", "n_rows"
    )


def read_universe_csv(
    spark: SparkSession,
    path: str,
    code_col: str = "code",
    name_col: str = "name",
    synonyms_col: str | None = "synonyms",
    description_col: str | None = "description",
    multi_line: bool = False,
) -> DataFrame:
    """(code, name, synonyms, description, n_rows): one row per code.

    Of several rows with a code the last counts; ``n_rows`` says how many there were.
    """
    df = read_delimited(spark, path, multi_line=multi_line)
    return _universe(df, code_col, name_col, synonyms_col, description_col)


def read_universe_tsv(
    spark: SparkSession, path: str, code_col: str = "icd10_code", name_col: str = "icd10_phe"
) -> DataFrame:
    return _universe(read_delimited(spark, path, "\t"), code_col, name_col, None, None)


def _records(df: DataFrame, code: str, name: str, candidates: Column, limit: int | None) -> DataFrame:
    missing = {code, name} - set(df.columns)
    if missing:
        raise ValueError(f"the input lacks columns {sorted(missing)}")
    rows = df.select(
        strip(_text(df, code)).alias("code"),
        strip(_text(df, name)).alias("name"),
        candidates.alias("direct_candidates"),
        F.md5(F.to_json(F.struct(*[_text(df, c).alias(c) for c in df.columns]), {"ignoreNullFields": "false"})).alias("digest"),
        *input_position(),
    )
    order = ["at_file", "at_block", "at_row"]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    numbered = number_rows(rows, ["digest"], [F.col(c) for c in order], "copy")
    key = F.concat_ws("-", "digest", F.col("copy").cast("string")).alias("record_id")
    return numbered.select(key, "code", "name", "direct_candidates")


def read_records_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(record_id, code, name, direct_candidates) from ``icd9_code, icd9_name, [candidates]``.

    ``record_id`` is the digest of the row's cells and its number among equal rows. It is the same however
    the rows are dealt to files and splits, so answers of a later run find their records. With
    ``multi_line`` quoted cells may hold line breaks and a file is one task's work; without it,
    large files are split.
    """
    df = read_delimited(spark, path, multi_line=multi_line)
    cell = next((c for c in CANDIDATE_COLUMNS if c in df.columns), None)
    return _records(df, "icd9_code", "icd9_name", parse_pipe_candidates(_text(df, cell)), None)


def read_records_tsv(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    candidates_col: str = "potential_matches",
    keep_colons: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Records with tagged candidates; ``limit`` keeps the first rows of the input."""
    df = read_delimited(spark, path, "\t", multi_line)
    cell = parse_tagged_candidates(_text(df, candidates_col), keep_colons=keep_colons)
    return _records(df, "icd9_code", "icd9_phe", cell, limit)


def read_pairs(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A pair table by its ending: .csv, .delta (if the connector is there), else Parquet.

    Without a schema the types of a CSV are inferred, but the columns of codes stay strings.
    """
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        if not schema:
            codes = {PairSpec().query, PairSpec().doc}
            found = reader.csv(path, inferSchema=True).schema
            schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in codes else f.dataType) for f in found])
        return reader.schema(schema).csv(path)
    if path.endswith(".delta"):
        return spark.read.format("delta").load(path)
    return spark.read.parquet(path)


def read_result_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A flat result, codes trimmed; the older category name is read as the present one.

    Rationales may hold line breaks, so a part file is read by one task unless told otherwise.
    A quoted empty cell is an empty text, as ``write_results_csv`` writes it; null has no quotes.
    """
    df = read_delimited(spark, path, multi_line=multi_line, keep_empty=True)
    df = df.withColumn("icd9_code", strip(F.col("icd9_code")))
    if "mapping_category" in df.columns:
        present = F.when(F.col("mapping_category") == OLD_CATEGORY, PRESENT_CATEGORY)
        df = df.withColumn("mapping_category", present.otherwise(F.col("mapping_category")))
    return df


def read_results_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Nested results; fields that an older file lacks are null."""
    text = T.StringType()
    candidate = "struct<code:string,name:string>"
    allowed = "array<struct<code:string,name:string,source:string,score:double>>"
    answer = {f.name: f.dataType.simpleString() for f in ANSWER}
    fields = {
        "input": f"struct<icd9_code:string,icd9_name:string,direct_candidates:array<{candidate}>>",
        **dict.fromkeys(
            ["selected_code", "selected_name", "confidence", "rationale", "mapping_category"],
            text.simpleString(),
        ),
        **dict.fromkeys(
            ["match_specificity", "external_choice_reason", "chosen_source"], text.simpleString()
        ),
        "allowed_candidates": allowed,
        "retrieved_top_k": "int",
        "validator_notes": "string",
        "num_attempts": "int",
        "attempted_returned_code": "string",
        "attempted_returned_name": "string",
        "salvage_strategy": "string",
        **{n: t for n, t in answer.items() if n == "is_multi_map" or n.startswith(("more_", "closest_"))},
    }
    return spark.read.schema(", ".join(f"{n} {t}" for n, t in fields.items())).json(path)
