"""End-to-end jobs of the mapping side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.functions.text import search_text
from termbridge.operators import prompts, resolve
from termbridge.operators.candidates import merge_candidates
from termbridge.operators.retrieval import retrieval_strategies, retrieve, strategy_summary
from termbridge.operators.skew import first_rows
from termbridge.operators.vectors import embed_text, fit_text_vectors
from termbridge.schemas import MapperConfig
from termbridge.session import cut_lineage


def embed_universe(universe: DataFrame, size: int = 256) -> tuple[PipelineModel, DataFrame]:
    """Fit word weights on the universe's search texts and add ``embedding``.

    The result is written once, as every search reads it.
    """
    text = search_text(
        F.col("code").cast("string"), F.col("name"), F.col("synonyms"), F.col("description")
    )
    described = universe.withColumn("text", text)
    model = fit_text_vectors(described, "text", size)
    embedded = embed_text(model, described, "text", "embedding").drop("text")
    return model, cut_lineage(embedded)


@dataclass(frozen=True)
class Prepared:
    """What a batch model run is asked, and the candidates that its answers are held against."""

    records: DataFrame
    retrieved: DataFrame
    candidates: DataFrame
    prompts: DataFrame
    schemas: DataFrame
    config: MapperConfig


def prepare(
    records: DataFrame,
    universe: DataFrame,
    model: PipelineModel,
    config: MapperConfig = MapperConfig(),
    synonyms: DataFrame | None = None,
    rules: str = prompts.SELECTION_RULES,
    **search,
) -> Prepared:
    """Retrieve and merge candidates once, with the messages and answer schema of every record.

    ``universe`` has code, name and embedding. Retrieved rows and candidates are
    written, since every later step reads them.
    """
    expanded = synonyms if config.synonym_expansion else None
    if config.synonym_expansion and synonyms is None:
        expanded = records.select("record_id", F.array().cast("array<string>").alias("synonyms"))
    top_k = config.synonym_top_k if config.synonym_expansion else config.retrieve_top_k
    retrieved = cut_lineage(retrieve(records, universe, model, top_k, expanded, **search))
    candidates = cut_lineage(merge_candidates(records, retrieved, universe))
    asked = prompts.selection_prompts(records, candidates, rules)
    schemas = prompts.response_schema(records, candidates)
    return Prepared(records, retrieved, candidates, asked, schemas, config)


def judge(prepared: Prepared, responses: DataFrame) -> DataFrame:
    """The verdict of every answer (record_id, attempt_index, raw_text) to the prepared prompts."""
    candidates, config = prepared.candidates, prepared.config
    made = responses.filter(F.col("attempt_index") < config.max_attempts)
    # Copies of an answer count once, and a null copy never stands for an answer.
    made = first_rows(made, ["record_id", "attempt_index"], [F.col("raw_text").asc_nulls_last()])
    return cut_lineage(resolve.validate_attempt(resolve.parse_response(made), candidates))


def next_round(prepared: Prepared, responses: DataFrame) -> DataFrame:
    """(record_id, attempt_index, messages) of the records that need another answer."""
    return prompts.next_attempt_messages(
        prepared.prompts, judge(prepared, responses), prepared.config.max_attempts
    )


def resolve_prepared(prepared: Prepared, responses: DataFrame, universe: DataFrame) -> DataFrame:
    """One result per record from the answers to the prepared prompts; the audit logs those prompts."""
    records, candidates, config = prepared.records, prepared.candidates, prepared.config
    verdicts = judge(prepared, responses)
    terminals = resolve.first_terminal_attempt(verdicts, config.max_attempts)
    chosen = resolve.canonical_multi_map(resolve.finalise_selection(terminals, records), universe)
    salvaged = resolve.salvage(records, terminals, candidates, config.max_attempts)
    audits = None
    if config.audit:
        asked = prompts.corrective_messages(verdicts, prepared.prompts, config.max_attempts)
        audits = resolve.attempt_audit(verdicts, asked, prepared.schemas, config.max_attempts)
    selections = chosen.unionByName(salvaged)
    return resolve.assemble_result(records, selections, candidates, prepared.retrieved, audits)


def map_records(
    records: DataFrame,
    universe: DataFrame,
    model: PipelineModel,
    responses: DataFrame,
    config: MapperConfig = MapperConfig(),
    synonyms: DataFrame | None = None,
    **search,
) -> DataFrame:
    """Both steps at once, for answers that are there already: see prepare and resolve_prepared."""
    prepared = prepare(records, universe, model, config, synonyms, **search)
    return resolve_prepared(prepared, responses, universe)


def diagnose_strategies(
    records: DataFrame,
    universe: DataFrame,
    dictionary: DataFrame,
    model: PipelineModel,
    targets: DataFrame,
    k: int = 40,
    factor: int = 5,
    **search,
) -> DataFrame:
    """For every strategy and wanted code (record_id, target): found, rank and score."""
    results = retrieval_strategies(records, universe, dictionary, model, k, factor, **search)
    return strategy_summary(results, targets, strategy_names(factor))


def strategy_names(factor: int = 5) -> Sequence[str]:
    return ["baseline", "name_only", "synonym_expansion", "multi_query", f"large_k_{factor}x"]
