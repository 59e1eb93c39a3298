"""Repeated lines are dropped everywhere but in the first document that holds them.

The hashes of lines seen so far live in levelled sorted runs: tables bucketed and sorted by hash,
so joining a batch with a run moves only the batch. Each batch of documents (in the order of doc_id)
anti-joins the runs, and the hashes that none of them has become a new run of level 0. When
``FAN_OUT`` runs of a level have gathered, they are merged into one of the next level. A run holds a
hash once, with the smallest doc_id that has the line, and a hash is in one run only.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased; keys are
compared by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termbridge.llm import arrays
from termbridge.session import cut_lineage, scratch_path

col = F.col
BATCHES = 4  # doc_id ranges of one call
FAN_OUT = 3  # runs of a level that are merged
MADE = ["n_lines", "n_dropped", "kept_sha256"]  # columns beside the input's
LEAST = 10  # code points of a key that counts
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(arrays.LOWER.tolist())


def _key(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short to count."""
    key = line.strip(BLANK)
    if len(key) < 4 * LEAST and sum((c & 0xC0) != 0x80 for c in key) < LEAST:
        return None
    return xxhash.xxh3_128_digest(key.translate(LOWER))


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every different key of a document once."""
    for batch in batches:
        for part in arrays.pieces(batch, "text"):
            ids, high, low = [], [], []
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                keys = {_key(line) for line in (text or b"").split(b"\n")} - {None}
                ids += [doc] * len(keys)
                for key in keys:
                    high.append(int.from_bytes(key[:8], "big", signed=True))
                    low.append(int.from_bytes(key[8:], "big", signed=True))
            arrays_ = [pa.array(x, pa.int64()) for x in (ids, high, low)]
            yield pa.RecordBatch.from_arrays(arrays_, ["doc_id", "high", "low"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the lines whose keys are in ``dropped`` (null: none)."""
    for batch in batches:
        for part in arrays.pieces(batch, "text"):
            kept, before, after, digests = [], [], [], []
            for text, dropped in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("dropped").to_pylist()):
                lines = (text or b"").split(b"\n")
                before.append(len(lines))
                if dropped:
                    keys = {x["high"].to_bytes(8, "big", signed=True) + x["low"].to_bytes(8, "big", signed=True) for x in dropped}
                    lines = [x for x in lines if _key(x) not in keys]
                after.append(len(lines))
                left = b"\n".join(lines)
                kept.append(left if text is not None else None)
                digests.append(hashlib.sha256(left).hexdigest())
            made = [
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(before, pa.int64()),
                pa.array([x - y for x, y in zip(before, after)], pa.int64()),
                pa.array(digests, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column("row"), *made], ["row", "text", *MADE])


class LineRuns:
    """The lines of all batches so far."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.width = spark, fan_out, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def _written(self, run: DataFrame) -> DataFrame:
        """A run as a table whose buckets are the partitions of a join on the hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        placed = run.select("high", "low", "first").repartition(self.width, "high", "low")
        writer = placed.write.bucketBy(self.width, "high", "low").sortBy("high", "low")
        writer.option("path", scratch_path(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch of (doc_id, high, low), of documents after all earlier ones.

        Returns the rows (doc_id, high, low) of the batch that repeat an earlier document's line.
        """
        own = lines.groupBy("high", "low").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last"))
        seen = own.withColumn("first", F.lit(None).cast("long"))
        for run in [r for level in self.levels for r in level]:
            run = run.withColumnRenamed("first", "found")
            seen = seen.join(run, ["high", "low"], "left")
            seen = seen.select("high", "low", "own", "last", F.coalesce("first", "found").alias("first"))
        seen = cut_lineage(seen)
        fresh = seen.where("first IS NULL").select("high", "low", col("own").alias("first"))
        self.levels[0].append(self._written(fresh))
        self._compact()
        repeated = seen.where("first IS NOT NULL OR own <> last").select("high", "low", F.coalesce("first", "own").alias("first"))
        return lines.join(repeated, ["high", "low"]).where("doc_id <> first").select("doc_id", "high", "low")

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan_out:
                merged = runs[0]
                for run in runs[1:]:
                    merged = merged.unionByName(run)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._written(merged))
                self.levels[level] = []


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``documents`` without the repeated lines in ``text``, and n_lines (before), n_dropped, kept_sha256.

    A null or empty text is one empty line and stays as it is. Lines with keys of fewer than 10 code
    points stay. A line repeated within the first document that holds it stays there each time.
    Rows that share a doc_id count as one document. Rows without doc_id keep all lines and take
    none from others. Input columns with the three names above are replaced. An empty table gives no rows.
    """
    spark = documents.sparkSession
    own = documents.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    lines = own.where(col("doc_id").isNotNull()).mapInArrow(_line_hashes, "doc_id long, high long, low long")
    lines = cut_lineage(lines)
    cuts = lines.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    runs, dropped = LineRuns(spark), None
    for low, high in zip(edges, edges[1:]):
        batch = lines if low is None else lines.where(col("doc_id") > low)
        batch = batch if high is None else batch.where(col("doc_id") <= high)
        gone = cut_lineage(runs.add(batch))
        dropped = gone if dropped is None else dropped.unionByName(gone)
    keys = dropped.groupBy(col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("high", "low")).alias("dropped"))
    others = [c for c in documents.columns if c not in [text, *MADE]]
    rows = documents.select(
        F.struct(*[col(f"`{c}`") for c in others]).alias("row"),
        col(doc_id).cast("long").alias("__doc"),
        col(text).cast("string").alias("text"),
    )
    rows = rows.join(keys, "__doc", "left").select("row", "text", "dropped")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_lines long, n_dropped long, kept_sha256 string"
    done = rows.mapInArrow(_without, schema)
    columns = [col("text").alias(text) if c == text else col(f"row.`{c}`") for c in documents.columns if c not in MADE]
    return done.select(*columns, *MADE)
