"""Column types, settings and fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CANDIDATE = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("name", T.StringType())]
)
CANDIDATES = T.ArrayType(CANDIDATE)

# The answer format that batch model runs return.
REQUIRED_ANSWER_FIELDS = [
    "best_match_icd10_code",
    "best_match_icd10_name",
    "confidence",
    "rationale",
    "mapping_category",
    "match_specificity",
    "external_choice_reason",
]
OPTIONAL_ANSWER_FIELDS = [
    "is_multi_map",
    "more_broad_icd10_code",
    "more_broad_icd10_name",
    "closest_exact_icd10_code",
    "closest_exact_icd10_name",
]
CONFIDENCE_LEVELS = ["strong", "medium", "weak", "no_confident_match"]
MAPPING_CATEGORIES = ["NONE", "DIRECT_MATCH", "OTHER_MATCH"]
SPECIFICITIES = ["EXACT", "CLOSE", "MORE_BROAD"]
EXTERNAL_REASONS = ["MULTIMAP", "BAD_MAPPING", "N/A"]

ANSWER = T.StructType(
    [
        T.StructField(f, T.BooleanType() if f == "is_multi_map" else T.StringType())
        for f in REQUIRED_ANSWER_FIELDS + OPTIONAL_ANSWER_FIELDS
    ]
)


@dataclass(frozen=True)
class PairSpec:
    """Names of the columns of a table of scored or labelled pairs."""

    query: str = "icd9_code"
    doc: str = "icd10_code"
    label: str = "correct"
    query_name: str | None = "icd9_phe"
    doc_name: str | None = "icd10_phe"
    features: list[str] = field(
        default_factory=lambda: [
            "cosine_tfidf_word",
            "jaccard_tokens",
            "dice_tokens",
            "levenshtein_ratio",
            "cos_similarity",
        ]
    )

    @property
    def id_columns(self) -> list[str]:
        return [c for c in (self.query, self.query_name, self.doc, self.doc_name) if c]

    @property
    def columns(self) -> list[str]:
        return [*self.id_columns, *self.features, self.label]


@dataclass(frozen=True)
class MapperConfig:
    """Settings of a mapping run."""

    retrieve_top_k: int = 40
    max_attempts: int = 2
    synonym_expansion: bool = False
    synonym_top_k: int = 40
    audit: bool = False
