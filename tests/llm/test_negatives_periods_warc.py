import random
import zlib

import numpy as np
import plain
import pytest
import zstandard
from pyspark.sql import functions as F

from termbridge.llm import hard_negatives as hn
from termbridge.llm import periods, queries, warc
from termbridge.session import scratch_path


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 11


def odd_vectors(seed, wide=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(700):
        v = [float(x) for x in np.round(rng.normal(size=6) * wide, 1)]
        rows.append((int(k), int(rng.integers(0, 3)), v))
    rows += [(k, 1, [0.5] * 6) for k in range(1000, 1200)]  # one vector for many rows: ties
    rows += [(k, 2, [0.0] * 6) for k in range(1200, 1230)] + [(1300, 0, [0.0] * 6)]
    rows += [rows[0], rows[0], (100, 1, [1.0] * 6), (50, None, [1.0] * 6), (None, 1, [1.0] * 6), (200, 1, None)]
    rows += [(300, 1, [1.0, None] + [0.0] * 4), (400, 1, [float("nan")] + [1.0] * 5), (500, 0, [float("inf")] + [1.0] * 5)]
    rows += [(600, 0, []), (601, 0, []), (602, 1, []), (700, 0, [1.0, 2.0]), (701, 0, [2.0, 2.0]), (702, 1, [1.5, 2.0])]
    return rows


@pytest.mark.parametrize("block_rows, cells, wide", [(None, 1 << 22, 1.0), (64, 500, 1.0), (200, 4000, 5e5)])
def test_hard_negatives_against_full_sorts(spark, block_rows, cells, wide):
    rows = odd_vectors(3, wide)
    given = spark.createDataFrame([(*r, 1, "s", 0) for r in rows], "vec_id long, label int, embedding array<double>, id int, slot string, key int")
    found = hn.hard_negatives(given, F.col("vec_id") % 100 == 0, block_rows=block_rows, cells=cells)
    expected = plain.hard_negatives(rows, lambda i: i % 100 == 0)
    assert len(expected) > 100
    assert sorted(rows_of(found)) == expected
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_nothing(spark):
    given = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert rows_of(hn.hard_negatives(given, F.col("vec_id") % 100 == 0)) == []
    alone = spark.createDataFrame([(100, 1, [1.0]), (101, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert rows_of(hn.hard_negatives(alone, F.col("vec_id") % 100 == 0)) == []


def test_scores_beyond_a_long_take_no_part(spark):
    rows = [(100, 1, [1e30]), (101, 1, [1e30]), (102, 2, [1e30]), (200, 1, [1e4]), (201, 1, [1e4]), (202, 2, [9e3])]
    given = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    scores = (2560000 * 2560000, 2560000 * 2304000)
    assert rows_of(hn.hard_negatives(given, F.col("vec_id") % 100 == 0)) == [(200, 201, 1, 202, *scores)]


def test_packed_keys_sort_like_their_parts():
    rng = random.Random(2)
    parts = [(rng.choice([-5, 0, 1 << 40]), rng.choice([0, 7]), rng.choice([-(1 << 61), -1, 0, 3, 1 << 61]), rng.randint(0, 1), rng.choice([-2, 9])) for _ in range(300)]
    keys = [hn._keys(*(np.array([x]) for x in p[:3]), p[3], np.array([p[4]])).column(0)[0].as_py() for p in parts]
    assert [hn.unpack_key(k) for k in keys] == parts
    assert [hn.unpack_key(k) for k in sorted(keys)] == sorted(parts, key=lambda p: (p[0], p[1], -p[2], p[3], p[4]))


def test_windows_close_at_their_bounds():
    keys = [(1, 1, 10, 0, 5), (1, 1, 10, 1, 2), (1, 1, 9, 0, 6), (1, 1, 8, 1, 3), (1, 1, 7, 1, 4), (2, 2, 7, 1, 9)]
    packed = [(hn._keys(*(np.array([x]) for x in k[:3]), k[3], np.array([k[4]])).column(0)[0].as_py(), None) for k in keys]
    assert list(hn.windows(2, 80, 100)(packed)) == [(1, 5, 1, 2, 10, 10), (1, 5, 2, 3, 10, 8), (1, 6, 1, 3, 9, 8)]


# 12


@pytest.mark.parametrize("n", [16, 32, 64, 128, 512, 8192])
def test_transform_round_trip(n):
    transform, opposite, shift = periods._plan(n)
    x = np.random.default_rng(1).integers(0, 40, (n // 2, 3))
    there = transform.forward(np.ascontiguousarray(x, dtype=float)[None])
    assert (np.mod(transform.inverse(there, n // 2)[0], periods.PRIME) == x).all()
    assert sorted(opposite.tolist()) == list(range(n)) and set(shift[:, 0]) == {1.0, -1.0}


def test_occurrences_are_exact():
    rng = np.random.default_rng(2)
    x = np.tile(rng.integers(0, 3, 40), 6)
    for block, offset in ((8, 0), (8, 8), (16, 16), (32, 32), (16, 48)):
        starts = np.arange(0, len(x) - block, block)
        k, e = periods.occurrences(x, block, starts, offset)
        padded = np.append(x, np.zeros(4 * block + offset, x.dtype))
        expected = {
            (n, d) for n, s in enumerate(starts) for d in range(block) if (padded[s : s + block] == padded[s + offset + d : s + offset + d + block]).all()
        }
        assert set(zip(k.tolist(), e.tolist())) == expected


def planted(rng):
    n = rng.choice([0, 1, 23, 24, 25, 60, 150, 400, 700])
    words = [rng.randrange(rng.choice([1, 2, 3, 50, 1000])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 24:
            a, p = rng.randrange(n), rng.randint(1, n // 4)
            for i in range(a + p, min(n, a + rng.randint(2 * p, 5 * p + 30))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("largest", [periods.LARGEST, 16])
def test_runs_against_all_periods(monkeypatch, largest):
    monkeypatch.setattr(periods, "LARGEST", largest)
    rng, seen = random.Random(5), 0
    for _ in range(120):
        rows = [planted(rng) for _ in range(rng.randint(1, 6))]
        offsets = np.cumsum([0] + [len(r) for r in rows])
        expected = [(k, *r) for k, row in enumerate(rows) for r in plain.runs(row)]
        assert periods.find_runs(np.array(sum(rows, []), np.int64), offsets) == expected
        seen += len(expected)
    assert seen > 80


def test_long_runs():
    assert periods.find_runs(np.zeros(100_000, np.int64), np.array([0, 100_000])) == [(0, 0, 100_000, 1)]
    x = np.tile(np.random.default_rng(1).integers(0, 2, 20_011), 4)
    assert periods.find_runs(x, np.array([0, len(x)]))[-1][1:] == (0, len(x), 20_011) or (0, 0, len(x), 20_011) in periods.find_runs(x, np.array([0, len(x)]))
    with pytest.raises(ValueError):
        periods.find_runs(x, np.array([0, len(x)]), 10, 2)


class Tables:
    """Stands for a session whose tables are given frames."""

    def __init__(self, **frames):
        self.frames, self.read = frames, self

    def parquet(self, path):
        return self.frames[path.rsplit("/", 1)[1].removesuffix(".parquet")]


def test_periodic_runs_of_odd_texts(spark, odd, empty):
    ids = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    rng = random.Random(8)
    texts = [" \t".join(f"w{rng.randrange(5 + k)}" for _ in range(rng.randint(1, 400))) for k in range(40)]
    more = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    given = odd.unionByName(more, allowMissingColumns=True)
    found = queries.op12_periodic_runs(Tables(documents=given), "x")
    expected = sorted((r.doc_id if r.doc_id is not None else -1, *map(str, plain.periodic(r.doc_id, r.text))) for r in given.collect())
    assert sorted((r[0] if r[0] is not None else -1, *map(str, r[1:])) for r in rows_of(found)) == expected
    assert rows_of(queries.op12_periodic_runs(Tables(documents=empty), "x")) == []


def test_periodic_runs_of_all_documents(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert found == {r.doc_id: plain.periodic(r.doc_id, r.text) for r in given}


# 13

LONG = "<p>" + "long page " * 50_000
PAGES = [
    (1, "http://a.example/x y\r\nWARC-Type: evil", "<html>" + "a" * 100),
    (2, None, "<html>" + "a" * 100),
    (0, "http://a.example/é", "<html>" + "a" * 100),
    (3, "", None),
    (4, "u", ""),
    (5, "u", "short"),
    (6, "u", "short"),
    (7, "u", "x" * 99),
    (8, "u", "x" * 99),
    (9, "u", "ü" * 50),
    (10, "u", "ü" * 50),
    (11, "u", LONG),
    (12, "u", LONG),
    (12, "u", LONG),
    (None, "n", LONG),
    (None, "n", "z" * 200),
    (None, "m", "z" * 200),
    (13, "r", "WARC/1.1\r\n\r\n\r\n" * 20),
    (13, "r", "WARC/1.1\r\n\r\n\r\n" * 20),
]


def plain_roles(rows):
    out, first = [], {}
    for i, _, t in rows:
        size = len((t or "").encode())
        if size >= 100 and i is not None:
            first[t] = min(i, first.get(t, i))
    done = set()
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (t or "").encode()
        kind, to = "response", None
        if len(body) >= 100 and t in done:
            kind, to = "revisit", first.get(t)
        done.add(t)
        out.append((str(i), len(body), plain.hashlib.sha256(body).hexdigest(), kind, str(to)))
    return sorted(out)


@pytest.mark.parametrize("archive_bytes", [1, 3000, warc.ARCHIVE_BYTES])
def test_warc_round_trip(spark, archive_bytes):
    given = spark.createDataFrame([(*r, "c", 5) for r in PAGES], "page_id long, url string, html string, digest string, size int").repartition(3)
    given = spark.createDataFrame(given.collect(), given.schema)
    path = scratch_path(spark, "warc")
    warc.write_archives(given, path, archive_bytes=archive_bytes)
    back = warc.read_archives(spark, path)
    found = back.collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == plain_roles(PAGES)
    assert len({r.record_id for r in found}) == len(PAGES)
    responses = {r.record_id: r for r in found if r.record_type == "response"}
    for r in found:
        if r.record_type == "revisit":
            to = responses[r.refers_to_id]
            assert (to.payload_digest, to.page_id, r.payload) == (r.payload_digest, r.refers_to, None)
        else:
            assert len(r.payload) == r.payload_bytes
    urls = {r.page_id: r.url for r in found}
    assert urls[1] == "http://a.example/x%20y%0D%0AWARC-Type:%20evil" and urls[0] == "http://a.example/é"
    assert urls[2] is None and urls[3] == ""
    assert warc.read_archives(spark, path, with_payload=False).columns == back.columns[:-1]


def test_warc_of_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert rows_of(warc.read_archives(spark, path)) == []


def test_archive_is_zstandard_with_a_leading_dictionary(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    files = spark.read.format("binaryFile").load(path).collect()
    assert files
    for file in files:
        data = bytes(file.content)
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        end = 8 + int.from_bytes(data[4:8], "little")
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:end]))
        assert held.dict_id() > 0
        reader = zstandard.ZstdDecompressor(dict_data=held).stream_reader(data[end:], read_across_frames=True)
        assert reader.read().split(b"\r\n")[0] == warc.VERSION  # a plain reader passes over the skippable frames
        assert b"".join(warc.records_of(data)).startswith(warc.VERSION)


def test_a_changed_payload_is_noticed():
    row = {"number": 1, "page_id": 1, "url": "u", "digest": plain.hashlib.sha256(b"abc").hexdigest(), "size": 3, "payload": b"abc"}
    made = warc.record(row, warc.DATE)
    assert warc.parse(made)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(made.replace(b"abc", b"abd"))
