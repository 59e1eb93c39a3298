"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

Bigrams are counted over all training texts in buckets by hash. A bigram of count c gets level
1 + floor(log2(c)) and is put into a Bloom filter once per level from 1 on; a reader asks
for level 1, 2, ... until the filter says no. Every bucket has its own slice of the filter, with ``BITS`` bits
per entry, in a table of the shared folder. The number of buckets grows with the bigrams, so a slice and
those who ask it fit a task at every size of corpus, and no count is left out.

A filter of a whole corpus has no size bound, so it is not broadcast: blocks of documents send their
different bigrams to the buckets, where they meet the slice and get levels back.

    p(w | v) = s * bigrams(v w) / c(v) + (1 - s) * p(w),   p(w) = (c(w) + 1) / (N + V + 1)

The share s depends on the size of c(v) in powers of two. It is the best of ``SHARES`` for all training
text when each token is taken out of the counts before it is scored (deleted interpolation). A level
stands for the middle of its range of counts, so p(. | v) sums to 1 only about, and the p(w) of all
V words and one unknown word sum to 1.

Unigram counts are exact. They are summed per bucket and go back to the blocks of documents that
hold the words, so the vocabulary is never broadcast. Words are known by 64-bit hashes.
A block keeps its bigrams as pairs of word numbers in order; their hashes are made where they are sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.llm import arrays
from termbridge.llm.blocks import BLOCK_BYTES, block_number, pack, placed, text_blocks, unpack
from termbridge.session import cut_lineage, shuffle_width

col = F.col
BITS = 12  # per entry
PER_BUCKET = 1 << 20  # hashes that blocks send to a bucket, about
PAIR_BITS = 48  # of the hash of a bigram: two alike are rarer than false yeses of the filter
PROBES = 4
SHARES = [0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9]
CLASSES = 64  # powers of two of c(v)
END = arrays.U64(0x5851F42D4C957F2D)  # the end of a text, and the context of its first word
BLOCKS = (
    "block long, words binary, counts binary, keys binary, pair_counts binary, "
    "doc_ids array<long>, train binary, lengths binary, codes binary, n_words long, n_pairs long"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its different words and bigrams, each with its count in training text, and the tokens as bigram numbers."""
    for n, block in enumerate(text_blocks(batches, BLOCK_BYTES // 2)):
        size, hashes, counts = block.num_rows, [], []
        for part in block.to_batches():
            for piece in arrays.pieces(part, "text", 1 << 20):  # work arrays are many times the text
                own, rows, _ = arrays.words(*arrays.flat(piece.column("text")))
                hashes.append(own)
                counts.append(np.bincount(rows, minlength=piece.num_rows))
        counts = np.concatenate(counts)
        train = np.array(block.column("train").to_pylist(), bool)
        is_end = np.zeros(int(counts.sum()) + size, bool)
        is_end[np.cumsum(counts + 1) - 1] = True
        tokens = np.full(len(is_end), END, arrays.U64)
        tokens[~is_end] = np.concatenate(hashes)
        del hashes, is_end
        learned = np.repeat(train, counts + 1)
        known, words = np.unique(tokens, return_inverse=True)
        del tokens
        # A text's first token follows an end: that of the text before, or one set before the block.
        keys = np.concatenate([np.searchsorted(known, [END]), words[:-1]]) * len(known) + words
        told = pack(np.bincount(words[learned], minlength=len(known)))
        del words
        keys, codes = np.unique(keys, return_inverse=True)
        packed = [told, pack(np.diff(keys, prepend=0)), pack(np.bincount(codes[learned], minlength=len(keys)))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block_number(n)], pa.int64()),
                pa.array([known.tobytes()], pa.binary()),
                *[pa.array([x], pa.binary()) for x in packed],
                pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([np.packbits(train).tobytes()], pa.binary()),
                pa.array([pack(counts + 1)], pa.binary()),
                pa.array([pack(codes)], pa.binary()),
                pa.array([len(known)], pa.int64()),
                pa.array([len(keys)], pa.int64()),
            ],
            [x.split()[0] for x in BLOCKS.split(", ")],
        )


def _bucket(hashes: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Buckets by the leading bits: hashes in order are buckets in order."""
    return ((hashes >> arrays.U64(bits - 32)) * arrays.U64(n)) >> arrays.U64(32)


def _dealt(hashes: np.ndarray, counts: np.ndarray, n: int, bits: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted hashes with their counts, bucket by bucket."""
    names, starts = np.unique(_bucket(hashes, n, bits).astype(np.int64), return_index=True)
    for k, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)]):
        yield k, hashes[a:b], counts[a:b]


def _hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, arrays.U64)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one large row at a time."""
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


ASKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])


def _ask_words(n_buckets: int):
    """A block's different words with their counts, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                words, counts = _hashes(row["words"]), unpack(row["counts"])
                order = np.argsort(words)
                out = [(row["block"], k, w.tobytes(), pack(c)) for k, w, c in _dealt(words[order], counts[order], n_buckets)]
                yield _rows(out, ASKS.names, ASKS.types)

    return run


def _ask_pairs(n_buckets: int, learned: bool):
    """A block's different bigrams bucket by bucket: those of training text with their counts, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                words, counts = _hashes(row["words"]), unpack(row["pair_counts"])
                pairs = _bigrams(words, *_pairs_of(row))
                if learned:
                    pairs, counts = pairs[counts > 0], counts[counts > 0]
                order = np.argsort(pairs)
                out = [
                    (row["block"], k, pack(np.diff(p, prepend=arrays.U64(0))), pack(c) if learned else None)
                    for k, p, c in _dealt(pairs[order], counts[order], n_buckets, PAIR_BITS)
                ]
                yield _rows(out, ASKS.names, ASKS.types)

    return run


def _sorted_pairs(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)).astype(arrays.U64)


def _merged(hashes: list[np.ndarray], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes, their summed counts, and where each given hash is among them."""
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, place, np.concatenate([unpack(c) for c in counts]))
    return known, total, place


def _tell_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """To every block the counts of its words of a bucket, and once the bucket's sums under block -1."""
    _, total, place = _merged([_hashes(w) for w in rows["words"]], rows["counts"])
    out, start, bucket = [(-1, rows["bucket"].iloc[0], None, int(total.sum()), int((total > 0).sum()))], 0, rows["bucket"].iloc[0]
    for block, words in zip(rows["block"], rows["words"]):
        n = len(words) // 8
        out.append((block, bucket, pack(total[place[start : start + n]]), 0, 0))
        start += n
    return pd.DataFrame(out, columns=["block", "bucket", "totals", "n_tokens", "n_types"])


def _pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of a block's bigrams."""
    return np.divmod(np.cumsum(unpack(row["keys"])), len(row["words"]) // 8)


def _bigrams(words: np.ndarray, befores: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before."""
    return arrays.mix(words[befores] * arrays.U64(0x9E3779B97F4A7C15) + words[seconds]) >> arrays.U64(64 - PAIR_BITS)


def _bits_of(hashes: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    shift = (level * PROBES + probe + 1) * 0xD6E8FEB86659FD93 % (1 << 64)
    return (arrays.mix(hashes + arrays.U64(shift)) % arrays.U64(size)).astype(np.int64)


class CountFilter:
    """Quantised counts of the hashes of a bucket."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, bits: int = BITS) -> CountFilter:
        """The filter of different hashes with counts from 1 on, with ``bits`` bits per entry."""
        levels = np.frexp(counts.astype(np.float64))[1]
        size = 64 * max(1, -(-int(levels.sum()) * bits // 64))
        marks = np.zeros(size, np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = hashes[levels >= level]
            for probe in range(PROBES):
                marks[_bits_of(own, level, probe, size)] = 1
        return cls(np.packbits(marks).tobytes())

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """1 + floor(log2(count)) or, by a false yes, more; 0 for unknown hashes or, by a false yes, more."""
        found, left, level = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 0
        while len(left) and level < 64:
            level += 1
            for probe in range(PROBES):
                at = _bits_of(hashes[left], level, probe, 8 * len(self.bits))
                left = left[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            found[left] = level
        return found


def middle(levels: np.ndarray) -> np.ndarray:
    """Middle of the whole numbers from 2^(level - 1) to 2^level - 1, 0 for level 0."""
    return np.where(levels > 0, 0.75 * 2.0**levels - 0.5, 0.0)


def _slice(bits: int):
    """A bucket's slice of the filter."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known, total, _ = _merged([_sorted_pairs(w) for w in rows["words"]], rows["counts"])
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "bits": [CountFilter.of(known, total, bits).bits.tobytes()]})

    return run


def _tell_levels(asked: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
    """To every block the levels of its bigrams of a bucket; a bucket in which nothing was learned has no slice."""
    filter_ = CountFilter(slices["bits"].iloc[0]) if len(slices) else None
    out = []
    for block, bucket, words in zip(asked["block"], asked["bucket"], asked["words"]):
        hashes = _sorted_pairs(words)
        out.append((block, bucket, pack(filter_.levels(hashes) if filter_ else np.zeros(len(hashes), np.int64))))
    return pd.DataFrame(out, columns=["block", "bucket", "levels"])


def _replies(hashes: np.ndarray, replies: list[dict] | None, block: int) -> np.ndarray:
    """The buckets' replies in the order of the block's hashes."""
    parts = sorted(replies or [], key=lambda r: r["bucket"])
    told = np.concatenate([unpack(r["told"]) for r in parts] or [np.zeros(0, np.int64)])
    if len(told) != len(hashes):
        raise ValueError(f"block {block} got replies on {len(told)} of its {len(hashes)} hashes")
    out = np.empty(len(hashes), np.int64)
    out[np.argsort(hashes)] = told
    return out


class _Block:
    """A block's different bigrams with the counts of all training text."""

    def __init__(self, row: dict, mass: float):
        words, (befores, seconds) = _hashes(row["words"]), _pairs_of(row)
        counts = _replies(words, row["of_words"], row["block"])
        pairs = _bigrams(words, befores, seconds)
        self.own, self.before = counts[seconds], counts[befores]
        self.single = (self.own + 1) / mass
        self.pairs = np.minimum(middle(_replies(pairs, row["of_pairs"], row["block"])), np.minimum(self.before, self.own))
        self.kind = np.frexp(np.maximum(self.before, 1).astype(np.float64))[1] - 1


def _tune(mass: float):
    """Log-likelihood of training tokens by kind of context and share, each taken out of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, len(SHARES)))
        for batch in batches:
            for row in _each(batch):
                b, times = _Block(row, mass), unpack(row["pair_counts"])
                own = times > 0
                times, kind, single = times[own], b.kind[own], b.own[own] / mass
                share = np.maximum(b.pairs[own] - 1, 0) / np.maximum(b.before[own] - 1, 1)
                for k, s in enumerate(SHARES):
                    sums[:, k] += np.bincount(kind, weights=times * np.log(s * share + (1 - s) * single), minlength=CLASSES)
        out = [(k, s, float(sums[k, s])) for k in range(CLASSES) for s in range(len(SHARES)) if sums[k].any()]
        yield _rows(out, ["kind", "share", "total"], [pa.int32(), pa.int32(), pa.float64()])

    return run


def _score(shares: list[float], mass: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = np.array(shares)
        for batch in batches:
            for row in _each(batch):
                b, codes, lengths = _Block(row, mass), unpack(row["codes"]), unpack(row["lengths"])
                train = np.unpackbits(np.frombuffer(row["train"], np.uint8))[: len(lengths)].astype(bool)
                s = by_kind[b.kind]
                chance = s * b.pairs / np.maximum(b.before, 1) + (1 - s) * b.single
                starts = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(~train),
                        pa.array(lengths),
                        pa.array(np.add.reduceat((b.own > 0).astype(np.int64)[codes], starts)),
                        pa.array(np.add.reduceat(np.log10(b.single)[codes], starts)),
                        pa.array(np.add.reduceat(np.log10(chance)[codes], starts)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score_texts(
    documents: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, bits: int = BITS
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Learns from rows whose boolean column ``train`` is true and scores all. Tokens are words and one
    end per text; a null or empty text is an end alone. If nothing is learned, all scores are 0.
    Rows may repeat or lack a doc_id; each gives a row. A null in ``train`` counts as false. An empty table gives no
    rows. Other columns are not read. ``bits`` of the filter per entry decide how many bigrams are
    known by mistake (12: less than 1 % of those asked for), ``buckets`` only how the work is dealt.
    """
    width = shuffle_width(documents)
    given = documents.select(
        col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"), F.coalesce(col(train), F.lit(False)).alias("train")
    )
    table = placed(given.mapInArrow(_blocks, BLOCKS), width, "block")
    sent = table.agg(F.sum("n_words"), F.sum("n_pairs")).first()
    n_words, n_pairs = [buckets or max(2 * width, -(-(n or 0) // PER_BUCKET)) for n in sent]

    asks = "block long, bucket int, words binary, counts binary"
    words = table.select("block", "words", "counts")
    told = words.mapInArrow(_ask_words(n_words), asks).groupBy("bucket").applyInPandas(
        _tell_counts, "block long, bucket int, totals binary, n_tokens long, n_types long"
    )
    told = cut_lineage(told)
    n_tokens, n_types = told.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()

    pairs = table.select("block", "words", "keys", "pair_counts")
    learned = pairs.mapInArrow(_ask_pairs(n_pairs, True), asks).drop("block")
    slices = cut_lineage(learned.groupBy("bucket").applyInPandas(_slice(bits), "bucket int, bits binary"))
    asked = pairs.mapInArrow(_ask_pairs(n_pairs, False), asks).drop("counts")
    levels = asked.groupBy("bucket").cogroup(slices.groupBy("bucket")).applyInPandas(_tell_levels, "block long, bucket int, levels binary")

    # Both kinds of replies gather at their block once; tuning and scoring then read what lies together.
    replies = told.where("block >= 0").select("block", F.struct("bucket", col("totals").alias("told")).alias("of_words"), F.lit(None).alias("of_pairs"))
    replies = replies.union(levels.select("block", F.lit(None), F.struct("bucket", col("levels").alias("told"))))
    replies = replies.groupBy("block").agg(F.collect_list("of_words").alias("of_words"), F.collect_list("of_pairs").alias("of_pairs"))
    rows = table.join(placed(replies, width, "block"), "block", "left")
    mass = float(n_tokens + n_types + 1)
    shown = ["block", "words", "keys", "of_words", "of_pairs"]
    tuned = rows.select(*shown, "pair_counts").mapInArrow(_tune(mass), "kind int, share int, total double")
    best: dict[int, tuple] = {}
    for r in tuned.groupBy("kind", "share").agg(F.sum("total").alias("total")).collect():  # CLASSES * len(SHARES) rows
        best[r["kind"]] = max(best.get(r["kind"], (-math.inf, 0)), (round(r["total"], 3), r["share"]))
    shares = [SHARES[best[k][1]] if k in best else 0.0 for k in range(CLASSES)]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    done = rows.select(*shown, "doc_ids", "train", "lengths", "codes").mapInArrow(_score(shares, mass), schema)
    return done.withColumn("train_tokens", F.lit(n_tokens).cast("long"))
