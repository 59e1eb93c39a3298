"""Byte-level BPE encoding and decoding by a global shuffle of the different words.

Texts are cut into pre-tokens by the tokenizer's pattern. A block of documents keeps, for each
position, the number of its pre-token in the block's list of different ones; the lists are dealt
into buckets by hash. In a bucket every different pre-token is merged once, whatever the number of
its documents, and the ids go back to the blocks, where they are set in place by position.
Decoding looks the ids up in the table of token bytes, whose size is that of the vocabulary.

Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.llm.blocks import block_number, pack, placed, ranked, text_blocks, unpack
from termbridge.session import shuffle_width

col = F.col
# Unicode's White_Space, which `\\s` stands for in the tokenizer's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEPARATOR = b"\xff"  # no byte of UTF-8


def own_pattern(pattern: str) -> str:
    """The tokenizer's pattern for this regex library, whose `\\s` has four characters more."""
    inside = regex.sub(r"\[\^\\s", f"[^{SPACE}", pattern)
    return inside.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def _blocks(pattern: str, n_buckets: int):
    """Per block a row of its documents and, per bucket, a row of its pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for n, block in enumerate(text_blocks(batches)):
            numbers: dict[str, int] = {}
            lengths, codes = [], []
            for text in block.column("text").to_pylist():
                found = split(text or "")
                lengths.append(len(found))
                codes.append(np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64))
            words = [w.encode() for w in numbers]
            codes, order = ranked(np.concatenate(codes), len(words))
            words = [words[k] for k in order.tolist()]
            buckets = np.array([xxhash.xxh3_64_intdigest(w) % n_buckets for w in words], np.int64)
            lists: dict[int, list[bytes]] = {}
            for w, k in zip(words, buckets.tolist()):
                lists.setdefault(k, []).append(w)
            squeeze, number = zstandard.ZstdCompressor(level=3), block_number(n)
            rest = [None] * len(lists)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (len(lists) + 1), pa.int64()),
                    pa.array([None, *lists], pa.int32()),
                    pa.array([None, *(squeeze.compress(SEPARATOR.join(x)) for x in lists.values())], pa.binary()),
                    pa.array([block.column("doc_id").to_pylist(), *rest], pa.list_(pa.int64())),
                    pa.array([pack(np.array(lengths)), *rest], pa.binary()),
                    pa.array([pack(codes), *rest], pa.binary()),
                    pa.array([pack(buckets), *rest], pa.binary()),
                ],
                ["block", "bucket", "words", "doc_ids", "lengths", "codes", "buckets"],
            )

    return run


BLOCKS = "block long, bucket int, words binary, doc_ids array<long>, lengths binary, codes binary, buckets binary"
_ENCODERS: dict[int, object] = {}


def _encoder(shared, pattern: str):
    if id(shared) not in _ENCODERS:
        _ENCODERS[id(shared)] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
    return _ENCODERS[id(shared)]._core_bpe.encode_single_piece


def _encode_bucket(shared, pattern: str):
    """All blocks' pre-tokens of a bucket: each different one is encoded once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        encode, known = _encoder(shared, pattern), {}
        out = []
        for block, words in zip(rows["block"], rows["words"]):
            ids = []
            for w in zstandard.ZstdDecompressor().decompress(words).split(SEPARATOR):
                found = known.get(w)
                if found is None:
                    found = known[w] = encode(w)
                ids.append(found)
            sizes = np.array([len(x) for x in ids])
            out.append((block, rows["bucket"].iloc[0], pack(sizes), pack(np.array([y for x in ids for y in x]))))
        return pd.DataFrame(out, columns=["block", "bucket", "sizes", "ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            codes, buckets, lengths = unpack(row["codes"]), unpack(row["buckets"]), unpack(row["lengths"])
            order = np.argsort(buckets, kind="stable")  # the buckets' lists, one after the other
            replies = sorted(row["replies"] or [], key=lambda r: r["bucket"])
            sizes = np.concatenate([unpack(r["sizes"]) for r in replies] or [np.zeros(0, np.int64)])
            ids = np.concatenate([unpack(r["ids"]) for r in replies] or [np.zeros(0, np.int64)])
            if len(sizes) != len(buckets):
                raise ValueError(f"block {row['block']} got ids of {len(sizes)} of its {len(buckets)} pre-tokens")
            size, start = np.zeros(len(buckets), np.int64), np.zeros(len(buckets), np.int64)
            size[order], start[order] = sizes, np.cumsum(sizes) - sizes
            ends = np.cumsum(lengths)
            for first in range(0, len(ends), 256):  # a few documents at a time
                last = min(first + 256, len(ends))
                low = int(ends[first - 1]) if first else 0
                own = codes[low : int(ends[last - 1])]
                many = size[own]
                total = np.concatenate([[0], np.cumsum(many)])
                flat = ids[np.repeat(start[own] - total[:-1], many) + np.arange(total[-1])].astype("<u4").tobytes()
                cuts = 4 * total[np.concatenate([[0], ends[first:last] - low])]
                texts = [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"][first:last], pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "ids"]
                )


def encode_texts(documents: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row: doc_id and ids, little-endian unsigned 32-bit integers one after the other.

    A null or empty text has no ids. Rows may repeat or lack a doc_id; each gives a row. An empty
    table gives no rows. Other columns are not read. ``ranks`` is a file of the driver.
    """
    spark = documents.sparkSession
    n_buckets = buckets or 2 * shuffle_width(documents)
    pattern = own_pattern(pattern)
    shared = spark.sparkContext.broadcast(read_ranks(ranks))  # as large as the vocabulary
    given = documents.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    table = placed(given.mapInArrow(_blocks(pattern, n_buckets), BLOCKS), shuffle_width(documents), "block")
    asked = table.where("bucket IS NOT NULL").select("block", "bucket", "words")
    told = asked.groupBy("bucket").applyInPandas(_encode_bucket(shared, pattern), "block long, bucket int, sizes binary, ids binary")
    replies = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("replies"))
    rows = table.where("bucket IS NULL").select("block", "doc_ids", "lengths", "codes", "buckets")
    return rows.join(replies, "block", "left").mapInArrow(_assemble, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null for null."""
    tokens = read_ranks(ranks)
    names = [b""] * (max(tokens.values(), default=-1) + 1)
    for name, k in tokens.items():
        names[k] = name
    data = np.frombuffer(b"".join(names), np.uint8)
    sizes = np.array([len(x) for x in names], np.int64)
    shared = encoded.sparkSession.sparkContext.broadcast((data, sizes, np.cumsum(sizes) - sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, sizes, starts = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for x in part.column(ids).to_pylist():
                    own = np.frombuffer(x or b"", "<u4")
                    many = sizes[own]
                    before = np.cumsum(many) - many
                    total = int(many.sum())
                    out.append(None if x is None else data[np.repeat(starts[own] - before, many) + np.arange(total)].tobytes())
                columns = [part.column(c) for c in part.schema.names if c != decoded]
                names_ = [c for c in part.schema.names if c != decoded]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*names_, decoded])

    kept = [f for f in encoded.schema.fields if f.name != decoded]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return encoded.mapInArrow(run, f"{schema}, `{decoded}` binary")
