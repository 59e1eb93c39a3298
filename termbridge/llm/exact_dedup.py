"""Exact copies by composable polynomial fingerprints.

A text (runs of `[\\x20\\x09-\\x0D]` replaced by one space) is cut into chunks of ``CHUNK`` bytes.
The chunks' polynomial hashes are computed side by side and combined by length-shifted
arithmetic, H(xy) = H(x) * base^|y| + H(y), under two moduli. Texts of equal length and
fingerprint are then compared chunk by chunk as a stream, so a collision never merges two texts.
A group with many copies is compared in several tasks, and their first texts with each other after.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.llm import arrays
from termbridge.session import cut_lineage

col = F.col
CHUNK = 65536
MODULI = (2147483647, 2147483629)  # primes below 2^31: a product of residues fits 64 bits
BASES = (1103515245, 1664525)
GROUP = 256  # copies that one task compares
SPACES = bytes(0x20 if arrays.WHITE[c] else c for c in range(256))
RUNS = re.compile(b"  +")


def normalised(text: bytes) -> bytes:
    text = text.translate(SPACES)
    return RUNS.sub(b" ", text) if b"  " in text else text


class Polynomial:
    """Hash of bytes under one modulus; hashes of neighbours combine."""

    def __init__(self, modulus: int, base: int):
        self.modulus, self.base = modulus, base % modulus
        powers = np.ones(CHUNK, np.uint64)
        for k in range(1, CHUNK):
            powers[k] = int(powers[k - 1]) * self.base % modulus
        self.powers = powers

    def chunk(self, data: np.ndarray) -> int:
        """Of at most CHUNK bytes: the last byte has weight 1. Sums stay below 2^55."""
        return int((self.powers[: len(data)][::-1] * (data.astype(np.uint64) + np.uint64(1))).sum() % self.modulus)

    def combine(self, left: int, right: int, right_length: int) -> int:
        return (left * pow(self.base, right_length, self.modulus) + right) % self.modulus

    def of(self, data: np.ndarray) -> int:
        total = 0
        for k in range(0, len(data), CHUNK):
            piece = data[k : k + CHUNK]
            total = self.combine(total, self.chunk(piece), len(piece))
        return total


def _fingerprints(moduli):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Polynomial(m, b) for m, b in zip(moduli, BASES)]
        for batch in batches:
            for part in arrays.pieces(batch, "text"):
                out = []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    text = normalised(text or b"")
                    data = np.frombuffer(text, np.uint8)
                    out.append((len(text), hashes[0].of(data), hashes[1].of(data), hashlib.sha256(text).hexdigest()))
                made = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)] + [pa.array([x[3] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("at"), *made], ["doc_id", "at", "length", "mark_a", "mark_b", "text_sha256"]
                )

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (length, marks, salt, at): which text of the group each row equals, by its ``at``.

    Only one text per different content of a group is held.
    """
    group, heads = None, []
    for batch in batches:
        for part in arrays.pieces(batch, "text"):
            keys = list(zip(*(part.column(c).to_pylist() for c in ("length", "mark_a", "mark_b", "salt"))))
            found = []
            for key, at, text in zip(keys, part.column("at").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                if key != group:
                    group, heads = key, []
                text = normalised(text or b"")
                alive = heads
                for k in range(0, len(text), CHUNK):
                    piece = text[k : k + CHUNK]
                    alive = [h for h in alive if h[1][k : k + CHUNK] == piece]
                    if not alive:
                        break
                if not alive:
                    alive = [(at, text)]
                    heads.append(alive[0])
                found.append(alive[0][0])
            names = ["length", "mark_a", "mark_b", "at"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.int64())], [*names, "head"])


def exact_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli: tuple[int, int] = MODULI, group: int = GROUP
) -> DataFrame:
    """Per row: doc_id, keep_id (smallest doc_id with the same text), group_size, kept, text_sha256.

    A null text counts as empty, so null and empty texts are copies of each other. Rows that share
    a doc_id are rows of their own; of such rows with the same text all have kept true if
    the doc_id is the smallest. Rows without doc_id are members of their group; if a group has no
    doc_id at all, keep_id is null and kept true. An empty table gives no rows. Other columns are not read.
    """
    keys = ["length", "mark_a", "mark_b"]
    given = documents.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    given = given.withColumn("at", F.xxhash64("doc_id", "text"))  # the row's name within its group
    schema = "doc_id long, at long, length long, mark_a long, mark_b long, text_sha256 string"
    marks = cut_lineage(given.mapInArrow(_fingerprints(moduli), schema))
    groups = cut_lineage(marks.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
    most = groups.agg(F.max("n")).first()[0] or 1
    met = marks.join(groups, keys).select("doc_id", "at", *keys, "n").distinct()
    same = (col("m.at") == col("g.at")) & col("m.doc_id").eqNullSafe(col("g.doc_id"))
    rows = met.alias("m").join(given.alias("g"), same).select("m.at", *[f"m.{k}" for k in keys], "m.n", "g.text")
    rows, tops, span = cut_lineage(rows.repartition(*keys, "at")), None, 1
    while span < most:  # first texts of more and more copies meet, at most about ``group`` at once
        span *= group
        salt = F.pmod(F.xxhash64("at"), F.ceil(col("n") / span)).cast("int")
        placed = rows.withColumn("salt", salt).repartition(*keys, "salt").sortWithinPartitions(*keys, "salt", "at")
        step = placed.mapInArrow(_classes, "length long, mark_a long, mark_b long, at long, head long")
        step = cut_lineage(step.distinct())
        rows = rows.join(step.select(*keys, col("head").alias("at")).distinct(), [*keys, "at"], "left_semi")
        above = step.select(*keys, col("at").alias("top"), col("head").alias("higher"))
        named = step.withColumnRenamed("head", "top")
        tops = named if tops is None else tops.join(above, [*keys, "top"]).select(*keys, "at", col("higher").alias("top"))

    done = marks.withColumn("class", col("at"))
    if tops is not None:
        done = marks.join(tops, [*keys, "at"], "left").withColumn("class", F.coalesce("top", "at"))
    sizes = done.groupBy(*keys, "class").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    done = done.join(sizes, [*keys, "class"])
    kept = F.coalesce(col("doc_id") == col("keep_id"), col("keep_id").isNull())
    return done.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
