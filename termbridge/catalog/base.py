"""Tables and query fragments that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termbridge.operators.pairs import clean_pairs, equal_weight_score
from termbridge.schemas import PairSpec
from termbridge.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, for comparison across engines."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in doubles})


# Pairs: order lines as candidates of their order. A line without discount has a
# missing feature; (order, line number) occurs several times.
SPEC = PairSpec(
    query="query_id",
    doc="doc_id",
    label="label",
    query_name=None,
    doc_name=None,
    features=["f_quantity", "f_discount", "f_tax", "f_price"],
)


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").alias("doc_id"),
        (F.col("l_quantity") / 50.0).alias("f_quantity"),
        (F.nullif("l_discount", F.lit(0.0)) * 10.0).alias("f_discount"),
        (F.col("l_tax") * 12.5).alias("f_tax"),
        (1.0 - F.col("l_extendedprice") / 105000.0).alias("f_price"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        "l_partkey",
        "l_suppkey",
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pairs(raw_pairs(spark, sf_dir), SPEC, [F.col("l_partkey"), F.col("l_suppkey")])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_weight_score(cleaned(spark, sf_dir), SPEC.features)


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored pairs written once, for operators that read them more than once."""
    return cut_lineage(scored(spark, sf_dir))


RAW_SQL = """
raw AS (
  SELECT l_orderkey AS query_id, l_linenumber AS doc_id,
         l_quantity / 50.0::DOUBLE AS f_quantity,
         nullif(l_discount, 0.0::DOUBLE) * 10.0::DOUBLE AS f_discount,
         l_tax * 12.5::DOUBLE AS f_tax,
         1.0::DOUBLE - l_extendedprice / 105000.0::DOUBLE AS f_price,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_partkey, l_suppkey
  FROM lineitem)"""

PAIRS_SQL = (
    RAW_SQL
    + """,
pairs AS (
  SELECT query_id, doc_id, f_quantity, f_discount, f_tax, f_price, label
  FROM (SELECT *, row_number() OVER (
          PARTITION BY query_id, doc_id
          ORDER BY l_partkey, l_suppkey, f_quantity, f_discount, f_tax, f_price, label) AS nth
        FROM raw WHERE f_discount IS NOT NULL)
  WHERE nth = 1),
scored AS (
  SELECT *, (f_quantity + f_discount + f_tax + f_price) / 4.0::DOUBLE AS score FROM pairs)"""
)

RANKED_SQL = (
    PAIRS_SQL
    + """,
ranked AS (
  SELECT *, (row_number() OVER w)::INTEGER AS rank,
         sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS found
  FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id)),
measures AS (
  SELECT query_id,
         coalesce(sum(CASE WHEN label = 1 THEN found::DOUBLE / rank END) / nullif(max(found), 0), 0.0) AS ap,
         coalesce(1.0::DOUBLE / min(CASE WHEN label = 1 THEN rank END), 0.0) AS rr,
         max(CASE WHEN rank = 1 THEN label::DOUBLE END) AS top1
  FROM ranked GROUP BY query_id),
decisions AS (
  SELECT *, CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS accept FROM ranked WHERE rank = 1)"""
)


def describe_sql(source: str, keys: str, value: str = "value") -> str:
    """Distribution of ``value`` by ``keys``."""
    return f"""
SELECT {keys}, count(*) AS count, round(avg({value}), 6) AS mean,
       round(stddev_samp({value}), 6) AS std, round(min({value}), 6) AS min,
       round(quantile_cont({value}, 0.25), 6) AS q25, round(quantile_cont({value}, 0.5), 6) AS q50,
       round(quantile_cont({value}, 0.75), 6) AS q75, round(max({value}), 6) AS max
FROM {source} GROUP BY {keys}"""


def long_sql(source: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{f}' AS feature, {f} AS value FROM {source}" for f in SPEC.features
    )


def bins_sql(source: str, keys: str, bins: int = 30) -> str:
    """Equal-width bins of (keys, value, n), as CTEs ``ranges``, ``binned`` and ``filled``."""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    using = f"JOIN ranges USING ({keys})" if keys else "CROSS JOIN ranges"
    width = f"((high - low) / {bins}.0::DOUBLE)"
    return f"""
ranges AS (
  SELECT {k}CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END::DOUBLE AS low,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END::DOUBLE AS high
  FROM {source} {group}),
guessed AS (
  SELECT {k}value, n, low, high,
         least(floor((value - low) * {bins}.0::DOUBLE / (high - low))::INTEGER, {bins - 1}) AS g
  FROM {source} {using}),
binned AS (
  SELECT {k}CASE WHEN value < low + g * {width} THEN g - 1
                 WHEN value >= low + (g + 1) * {width} AND g < {bins - 1} THEN g + 1
                 ELSE g END AS bin, sum(n) AS n
  FROM guessed GROUP BY ALL),
filled AS (
  SELECT {k}r.bin::INTEGER AS bin, low + r.bin * {width} AS low, low + (r.bin + 1) * {width} AS high,
         coalesce(n, 0)::BIGINT AS n
  FROM (SELECT * FROM ranges CROSS JOIN (SELECT unnest(range({bins})) AS bin)) r
  LEFT JOIN binned USING ({k}bin))"""
