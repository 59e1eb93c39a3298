"""Writers of results, audits, evaluation tables and the universe with its vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the flat result by profile.
_SELECTION = [
    "selected_code",
    "selected_name",
    "confidence",
    "rationale",
    "mapping_category",
    "match_specificity",
    "external_choice_reason",
]
_MULTI = [
    "is_multi_map",
    "more_broad_icd10_code",
    "more_broad_icd10_name",
    "closest_exact_icd10_code",
    "closest_exact_icd10_name",
]
_ATTEMPTS = ["num_attempts", "attempted_returned_code", "attempted_returned_name", "salvage_strategy"]
PROFILES = {
    "batch": [*_SELECTION, "chosen_source", "retrieved_top_k", *_ATTEMPTS],
    "tsv": [*_SELECTION, *_MULTI, *_ATTEMPTS],
    "demo": [*_SELECTION, *_ATTEMPTS],
}


def flat_results(results: DataFrame, profile: str = "tsv") -> DataFrame:
    """The nested results as flat columns, code and name first."""
    return results.select("input.icd9_code", "input.icd9_name", *PROFILES[profile])


def write_results_jsonl(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line with null fields written out; audits are left out."""
    kept = [c for c in results.columns if c not in ("record_id", "audit")]
    results.select(*kept).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_results_csv(
    results: DataFrame, path: str, profile: str = "tsv", mode: str = "errorifexists"
) -> None:
    flat = flat_results(results, profile)
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat.write.mode(mode).option("header", True).option("escape", '"').options(**kept).csv(path)


def write_audit_jsonl(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The rows that have an audit, with it."""
    audited = results.filter(F.col("audit").isNotNull()).drop("record_id")
    audited.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_eval_outputs(
    comparison: DataFrame,
    decisions: DataFrame,
    predictions: DataFrame,
    folder: str,
    mode: str = "errorifexists",
) -> None:
    """Model comparison and decisions as CSV, all predictions as Parquet."""
    comparison.write.mode(mode).option("header", True).csv(f"{folder}/model_comparison")
    decisions.write.mode(mode).option("header", True).csv(f"{folder}/best_decisions")
    predictions.write.mode(mode).parquet(f"{folder}/predictions")


@dataclass(frozen=True)
class IndexConfig:
    embedding: str = "hashed_tfidf"
    size: int = 256
    normalized: bool = True


def save_index(
    universe: DataFrame,
    folder: str,
    config: IndexConfig = IndexConfig(),
    mode: str = "errorifexists",
    model: PipelineModel | None = None,
) -> None:
    """Write (code, name, synonyms, description, embedding), the model's word weights, then the settings.

    Without ``model`` only vectors of the same encoder can be searched for. The settings are written last, so an index that has them is complete.
    """
    spark = universe.sparkSession
    universe.select("code", "name", "synonyms", "description", "embedding").write.mode(mode).parquet(
        f"{folder}/universe"
    )
    if model is not None:
        (model.write().overwrite() if mode == "overwrite" else model.write()).save(f"{folder}/model")
    row = (config.embedding, config.size, config.normalized)
    table = spark.createDataFrame([row], "embedding string, size int, normalized boolean")
    table.coalesce(1).write.mode(mode).parquet(f"{folder}/config")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, IndexConfig]:
    row = spark.read.parquet(f"{folder}/config").first()
    config = IndexConfig(row["embedding"], row["size"], row["normalized"])
    return spark.read.parquet(f"{folder}/universe"), config


def load_index_model(folder: str) -> PipelineModel:
    """The word weights saved with an index: embeds query texts in its space."""
    return PipelineModel.load(f"{folder}/model")


def index_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/config/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def build_if_missing(spark: SparkSession, folder: str, build, config: IndexConfig = IndexConfig()):
    """Load the index in ``folder``, first writing what ``build()`` returns if it is not there.

    ``build()`` returns the universe, or the universe and its model. An index with
    other settings than ``config`` is refused.
    """
    if not index_exists(spark, folder):
        built = build()
        universe, model = built if isinstance(built, tuple) else (built, None)
        save_index(universe, folder, config, "overwrite", model)
    universe, found = load_index(spark, folder)
    if found != config:
        raise ValueError(f"the index in {folder} was built with {found}, not {config}")
    return universe, found
