"""Cell parsing and query texts as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termbridge.schemas import CANDIDATES

WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_list(cell: Column) -> Column:
    """``a| b ||c`` to ``[a, b, c]``; null and blank cells give an empty list."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda part: part != "")


def parse_pipe_candidates(cell: Column) -> Column:
    """``C1|C2:Name`` to an array of (code, name); the first colon ends the code."""

    def candidate(part: Column) -> Column:
        colon = F.instr(part, ":")
        code = F.when(colon > 0, strip(F.substr(part, F.lit(1), colon - 1))).otherwise(part)
        name = F.when(colon > 0, strip(F.substr(part, colon + 1)))
        return F.struct(code.alias("code"), name.alias("name"))

    return F.transform(split_list(cell), candidate)


def parse_tagged_candidates(
    cell: Column,
    code_key: str = "icd10_code",
    name_key: str = "phenoname",
    keep_colons: bool = False,
) -> Column:
    """``ICD10_code:C:phenoname:N | ...`` to an array of (code, name).

    Tokens between colons are read as key and value in turn; keys ignore case,
    the last of equal keys counts, and entries without a code are dropped. A
    name therefore ends at its first colon; ``keep_colons`` keeps the rest.
    """

    # Inside lambdas nothing is shared by itself: tokens and pairs are bound so that each is made once.
    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def paired(tokens: Column) -> Column:
        starts = F.when(
            F.size(tokens) >= 2, F.sequence(F.lit(0), F.size(tokens) - 2, F.lit(2))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.struct(
                F.lower(F.get(tokens, i)).alias("key"), F.get(tokens, i + 1).alias("value")
            ),
        )

    def candidate(part: Column) -> Column:
        def read(pairs: Column) -> Column:
            def last(key: str) -> Column:
                return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]

            name = last(name_key)
            if keep_colons:
                rest = strip(F.regexp_extract(part, rf"(?is){name_key}\s*:(.*)$", 1))
                name = F.when(name.isNotNull(), rest)
            return F.struct(last(code_key).alias("code"), name.alias("name"))

        return bound(bound(F.transform(F.split(part, ":"), strip), paired), read)

    entries = F.transform(split_list(cell), candidate)
    return F.filter(entries, lambda c: F.coalesce(c["code"], F.lit("")) != "").cast(CANDIDATES)


def search_text(code: Column, name: Column, synonyms: Column, description: Column) -> Column:
    """The text a universe row is searched by; absent parts are left out."""
    return F.concat_ws(" | ", code, name, synonyms, F.nullif(description, F.lit("")))


def query_text(code: Column, name: Column) -> Column:
    return F.concat_ws(" | ", code, name)


def query_variants(name: Column, synonyms: Column, include_original: bool = True) -> Column:
    """The name followed by its non-blank synonyms; repeated texts stay."""
    none = F.array().cast(T.ArrayType(T.StringType()))
    others = F.filter(
        F.transform(F.coalesce(synonyms, none), strip), lambda s: F.coalesce(s, F.lit("")) != ""
    )
    return F.concat(F.array(name), others) if include_original else others


def clean_synonyms(answer: Column) -> Column:
    """Synonyms of a ``{"synonyms": [...]}`` answer, trimmed; a bad answer gives none."""
    parsed = F.from_json(answer, "struct<synonyms:array<string>>")["synonyms"]
    none = F.array().cast(T.ArrayType(T.StringType()))
    return F.filter(
        F.transform(F.coalesce(parsed, none), strip), lambda s: F.coalesce(s, F.lit("")) != ""
    )


def synonym_count_in_range(synonyms: Column, low: int = 4, high: int = 8) -> Column:
    """Whether the answer keeps the size the request asked for."""
    return F.size(synonyms).between(low, high)
