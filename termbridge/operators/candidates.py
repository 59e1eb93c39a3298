"""The list of candidates a record may choose from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_candidates(records: DataFrame, retrieved: DataFrame, universe: DataFrame) -> DataFrame:
    """Direct candidates in input order, then retrieved ones by rank, first of each code.

    ``records`` has record_id and direct_candidates, ``retrieved`` record_id, code,
    score and rank, ``universe`` code and name (unique by code). A direct candidate
    takes the universe's name, else the given one, else "", and has no score; a
    retrieved code the universe lacks is dropped. A record's list is as long as
    its own direct candidates and the search's k, never longer.
    """
    direct = records.select(
        "record_id", F.posexplode("direct_candidates").alias("at", "given")
    ).select(
        "record_id",
        F.lit(0).alias("kind"),
        "at",
        F.col("given.code").alias("code"),
        F.col("given.name").alias("given_name"),
        F.lit(None).cast("double").alias("score"),
    )
    found = retrieved.select(
        "record_id",
        F.lit(1).alias("kind"),
        F.col("rank").alias("at"),
        F.col("code").cast("string").alias("code"),
        F.lit(None).cast("string").alias("given_name"),
        F.col("score").cast("double").alias("score"),
    )
    names = universe.select(
        F.col("code").cast("string").alias("code"),
        F.col("name").alias("known_name"),
        F.lit(True).alias("in_universe"),
    )
    known = F.coalesce("in_universe", F.lit(False))
    named = (
        direct.unionByName(found)
        .join(names, "code", "left")
        .withColumn("in_universe", known)
        .filter((F.col("kind") == 0) | F.col("in_universe"))
    )
    # Both steps below need a record's rows together: one shuffle serves them.
    together = named.repartition("record_id")
    first = Window.partitionBy("record_id", "code").orderBy("kind", "at")
    order = Window.partitionBy("record_id").orderBy("kind", "at")
    return (
        together.withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") == 1)
        .select(
            "record_id",
            F.row_number().over(order).alias("pos"),
            "code",
            F.coalesce(F.when(F.col("in_universe"), F.col("known_name")), "given_name", F.lit("")).alias(
                "name"
            ),
            F.when(F.col("kind") == 0, "direct").otherwise("retrieved").alias("source"),
            "score",
            "in_universe",
        )
    )


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """One ordered array of candidates per record."""
    entry = F.struct("pos", "code", "name", "source", "score")
    return candidates.groupBy("record_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda c: F.struct(c["code"].alias("code"), c["name"].alias("name"), c["source"].alias("source"), c["score"].alias("score")),
        ).alias("allowed_candidates")
    )
