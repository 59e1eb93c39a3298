"""Text to vectors: hashed TF-IDF fitted on the universe, and exact TF-IDF cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.functions.similarity import word_list


def fit_text_vectors(universe: DataFrame, text: str = "text", size: int = 256) -> PipelineModel:
    """Fit word weights on the universe. What is collected is one number per slot."""
    stages = [
        RegexTokenizer(
            inputCol="__text", outputCol="__words", pattern="[a-z0-9]+", gaps=False, toLowercase=True
        ),
        HashingTF(inputCol="__words", outputCol="__counts", numFeatures=size),
        IDF(inputCol="__counts", outputCol="__weights"),
        Normalizer(inputCol="__weights", outputCol="__unit"),
    ]
    return Pipeline(stages=stages).fit(universe.select(F.coalesce(text, F.lit("")).alias("__text")))


def embed_text(
    model: PipelineModel, df: DataFrame, text: str = "text", name: str = "vec"
) -> DataFrame:
    """Add the unit vector of ``text``; a text without known words is a zero vector."""
    applied = model.transform(df.withColumn("__text", F.coalesce(text, F.lit(""))))
    return applied.withColumn(name, vector_to_array("__unit")).select(*df.columns, name)


def word_counts(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    words = df.select(*key, F.explode(word_list(F.col(text))).alias("word"))
    return words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))


def inverse_document_frequency(universe: DataFrame, key: str, text: str) -> DataFrame:
    """ln((N + 1) / (df + 1)) of every word of the universe."""
    words = universe.select(key, F.explode(F.array_distinct(word_list(F.col(text)))).alias("word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n_docs = universe.agg(F.count(F.lit(1))).scalar()
    return frequency.select("word", F.log((n_docs + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def cosine_tfidf_word(
    pairs: DataFrame, left: str, right: str, universe: DataFrame, key: str, text: str
) -> DataFrame:
    """Add ``cosine_tfidf_word`` of the two texts of each pair.

    Weights are computed once per distinct text and word, under the text's
    digest, so long texts are not shuffled with every word. A word the universe
    lacks has the weight of a word in no document. Only the given pairs are
    scored; texts without a common word, or without any weight, score 0.
    """
    texts = (
        pairs.select(F.col(left).alias("text"))
        .union(pairs.select(F.col(right).alias("text")))
        .select(F.md5("text").alias("digest"), "text")
        .groupBy("digest")
        .agg(F.first("text", ignorenulls=True).alias("text"))
        .filter(F.col("text").isNotNull())
    )
    unseen = F.log(universe.agg(F.count(F.lit(1))).scalar() + 1.0)
    weighted = (
        word_counts(texts, ["digest"], "text")
        .join(inverse_document_frequency(universe, key, text), "word", "left")
        .withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    )
    # One entry per word of one text.
    weights = weighted.groupBy("digest").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("w"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    a = weights.select(F.col("digest").alias("da"), F.col("w").alias("wa"), F.col("norm").alias("na"))
    b = weights.select(F.col("digest").alias("db"), F.col("w").alias("wb"), F.col("norm").alias("nb"))
    shared = F.aggregate(
        F.map_entries("wa"),
        F.lit(0.0),
        lambda total, e: total + e["value"] * F.coalesce(F.try_element_at("wb", e["key"]), F.lit(0.0)),
    )
    keyed = pairs.withColumns({"da": F.md5(left), "db": F.md5(right)})
    return keyed.join(a, "da", "left").join(b, "db", "left").select(
        *[F.col(c) for c in pairs.columns],
        F.coalesce(F.try_divide(shared, F.col("na") * F.col("nb")), F.lit(0.0)).alias(
            "cosine_tfidf_word"
        ),
    )
