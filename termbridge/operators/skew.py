"""Running totals and row numbers that do not need a whole group in one task.

Rows are range partitioned by group and order, so a large group spreads over many tasks and small ones share
one. Each task adds up its slice of the sorted rows; what earlier slices hold of a slice's first group
comes from one row a slice. The pairs are shuffled once, whatever the sizes of the groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termbridge.session import cut_lineage, shuffle_width


def range_slices(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Sort-partition the rows and add the partition number as ``slice``.

    The number of partitions is given, so adaptive execution keeps them apart.
    """
    return df.repartitionByRange(shuffle_width(df), *order).withColumn(
        "slice", F.spark_partition_id()
    )


def _slice_sums(names: Sequence[str]):
    """Running sums within one sorted slice, and at its end a row of what the slice ends with.

    ``__group`` tells groups apart. The last row has the slice's first and last group and the sums so far of
    the last one; its other columns are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_number, first, last = TaskContext.get().partitionId(), None, None
        carried, schema = dict.fromkeys(names, 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("__group").to_numpy()
            begins = np.flatnonzero(np.append(last is None or group[0] != last, group[1:] != group[:-1]))
            run_of = np.zeros(batch.num_rows, np.int64)
            run_of[begins] = 1
            run_of = np.cumsum(run_of)  # 0: the group that goes on from the batch before
            made = {}
            for name in names:
                total = np.cumsum(batch.column(name).to_numpy())
                before = np.concatenate([[-carried[name]], np.append(0, total)[begins]])
                total = total - before[run_of]
                carried[name] = total[-1].item()
                made[name] = pa.array(total)
            first = group[0].item() if first is None else first
            last = group[-1].item()
            kept = [made[c] if c in made else batch.column(c) for c in batch.schema.names]
            ends = [pa.nulls(batch.num_rows, pa.int64()), pa.array(np.full(batch.num_rows, slice_number, np.int32))]
            yield pa.RecordBatch.from_arrays([*kept, *ends], [*batch.schema.names, "__last", "slice"])
            schema = batch.schema
        if schema is not None:
            end = {**carried, "__group": first}
            alone = [pa.array([end.get(f.name)], f.type) for f in schema]
            alone += [pa.array([last], pa.int64()), pa.array([slice_number], pa.int32())]
            yield pa.RecordBatch.from_arrays(alone, [*schema.names, "__last", "slice"])

    return run


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums of whole numbers within each group, in the given total order.

    Nulls form a group like any other value and count as 0 in a sum. The sorted slices are written once to the
    shared folder; the rows they end with are as many as there are slices.
    """
    group, names = list(group), list(sums)
    counted = {n: F.coalesce(c.cast("long"), F.lit(0).cast("long")) for n, c in sums.items()}
    given = df.withColumns({**counted, "__group": F.xxhash64(*group) if group else F.lit(0).cast("long")})
    keys = [*map(F.col, group), *order] or [F.col("__group")]
    placed = given.repartitionByRange(shuffle_width(df), *keys).sortWithinPartitions(*keys)
    fields = [T.StructField(f.name, f.dataType) for f in placed.schema]
    schema = T.StructType([*fields, T.StructField("__last", T.LongType()), T.StructField("slice", T.IntegerType())])
    local = cut_lineage(placed.mapInArrow(_slice_sums(names), schema))
    ends = local.where("__last is not null")
    held = ends.select(F.col("__last").alias("g"), "slice", F.lit(1).alias("after"), *names)
    asked = ends.select(F.col("__group").alias("g"), "slice", F.lit(0).alias("after"), *[F.lit(0).cast("long").alias(n) for n in names])
    earlier = Window.partitionBy("g").orderBy("slice", "after").rowsBetween(Window.unboundedPreceding, -1)
    carry = held.unionAll(asked).select("g", "slice", "after", *[F.sum(n).over(earlier).alias(f"__{n}") for n in names])
    carry = carry.where("after = 0").select(F.col("g").alias("__first"), "slice", *[F.coalesce(f"__{n}", F.lit(0)).alias(f"__{n}") for n in names])
    whole = local.where("__last is null").join(F.broadcast(carry), "slice")
    more = {n: F.col(n) + F.when(F.col("__group") == F.col("__first"), F.col(f"__{n}")).otherwise(0) for n in names}
    kept = [c for c in df.columns if c not in names]
    return whole.withColumns(more).select(*kept, *names)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1."""
    numbered = running_sums(df, group, order, {name: F.lit(1)})
    return numbered.withColumn(name, F.col(name).cast("int"))


def first_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, name: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group, with their number if ``name`` is given.

    Up to a limit on ``n``, Spark cuts each map task's share of a group to ``n`` rows
    before the shuffle (window group limit), so large groups shrink first. Beyond
    that limit the rows are numbered like any others.
    """
    number = name or "row"
    threshold = "spark.sql.optimizer.windowGroupLimitThreshold"
    if n <= int(df.sparkSession.conf.get(threshold, "1000")):
        w = Window.partitionBy(*group).orderBy(*order)
        numbered = df.withColumn(number, F.row_number().over(w))
    else:
        numbered = number_rows(df, group, order, number)
    first = numbered.filter(F.col(number) <= n)
    return first if name else first.drop(number)
