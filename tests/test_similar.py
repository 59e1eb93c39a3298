import random
import re
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termbridge.catalog import text_queries
from termbridge.operators import overlap, similar


def words(text):
    return frozenset(re.findall("[a-z0-9]+", (text or "").lower()))


def all_pairs(left, right, threshold, measure):
    """Brute force; right None: pairs of left, the smaller key first."""
    least, out = Fraction(str(threshold)), []
    own = right is None
    there = [(k, words(t)) for k, t in (left if own else right)]
    for k, x in ((k, words(t)) for k, t in left):
        for m, y in there:
            if x and y and k is not None and m is not None and (not own or k < m):
                common = len(x & y)
                value = Fraction(common, len(x | y)) if measure == "jaccard" else Fraction(2 * common, len(x) + len(y))
                if value >= least:
                    out.append((k, m, round(float(value), 9)))
    return sorted(out)


def found(df):
    return sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    return [(k, " ".join(f"w{min(int(rng.paretovariate(0.7)), rng.choice([8, 40]))}" for _ in range(rng.randint(0, 9)))) for k in range(n)]


ROWS = [
    *made(4, 250),
    *((1000 + k, "A, b c-D e!") for k in range(15)),
    *((3000 + k, " ".join(f"h{i}" for i in range(10)) + f" x{k}") for k in range(40)),
    (2000, None),
    (2001, " ?! "),
    (None, "a b c d e"),
    (7, "a b c d e"),
]


@pytest.mark.parametrize("threshold, measure, plan", [
    (0.6, "jaccard", {}), (0.6, "jaccard", {"cell_rows": 4}), (0.75, "dice", {"cell_rows": 4, "depth": 2}), (1, "jaccard", {"cell_rows": 4}),
    (0.3, "jaccard", {"cell_rows": 3, "depth": 6}),
])
def test_pairs_against_all_pairs(spark, threshold, measure, plan):
    other = made(5, 150)
    left = spark.createDataFrame([(*r, 1) for r in ROWS], "k long, t string, id int").repartition(3)
    right = spark.createDataFrame(other, "k2 long, t2 string")
    both = similar.similar_pairs(left, right, "k", "t", threshold, measure, "k2", "t2", **plan)
    assert found(both) == all_pairs(ROWS, other, threshold, measure)
    if plan:
        own = similar.similar_pairs(left, None, "k", "t", threshold, measure, **plan)
        assert found(own) == all_pairs(ROWS, None, threshold, measure)


def test_classes_keep_copies_together(spark):
    rows = [(k, "same words here") for k in range(500)] + [(900, "same words there"), (901, "HERE, words: same")]
    members = similar.token_classes(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert {(r.k, r.class_id) for r in members.collect()} == {(k, 0) for k in [*range(500), 901]} | {(900, 900)}
    assert found(similar.similar_classes(members, None, 0.5)) == [(0, 900, 0.5)]


def test_a_common_word_is_not_paired_whole(spark, monkeypatch):
    """4,000 sets share two words and nothing else: cells of one word would hold 8 million pairs."""
    rows = spark.range(4000).select(F.col("id").alias("k"), F.format_string("common words a%d b%d c%d", "id", "id", "id").alias("t"))
    met, paired = [], similar._paired

    def counted(*args):
        out = paired(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(similar, "_paired", counted)
    assert found(similar.similar_pairs(rows, None, "k", "t", 0.6)) == []
    assert sum(met) == 0


def test_common_words_alone(spark, monkeypatch):
    """Sets of three of 24 words: every word is in an eighth of them, pairs of words are what links."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.sample([f"v{i}" for i in range(24)], 3))) for k in range(1500)]
    frame = spark.createDataFrame(rows, "k long, t string")
    members = similar.token_classes(frame, "k", "t")
    classes = {r.class_id: r.tokens for r in members.collect()}
    expected = all_pairs(list(classes.items()), None, 0.5, "jaccard")
    assert found(similar.similar_classes(members, None, 0.5, cell_rows=32)) == expected


def test_nothing(spark):
    empty = spark.createDataFrame([], "k long, t string")
    assert found(similar.similar_pairs(empty, None, "k", "t", 0.5)) == []
    assert found(similar.similar_pairs(empty, empty, "k", "t", 0.5)) == []
    for bad in ({"threshold": 0}, {"threshold": 1.1}, {"threshold": 0.5, "measure": "cosine"}):
        with pytest.raises(ValueError):
            similar.similar_pairs(empty, None, "k", "t", **bad)


def test_links_count_copies_without_pairing_them(spark):
    """300 copies on either side of a link gave 300 * 300 rows and more; now a row each."""
    rows = [(i, "a b c d") for i in range(300)] + [(300 + i, "a b c e") for i in range(300)] + [(600, "z"), (601, ""), (602, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = {tuple(r) for r in similar.similar_links(df, None, "id", "text", 0.5).collect()}
    expected = {(i, 0, 599) for i in range(300)} | {(i, 300, 599) for i in range(300, 600)}
    assert found == expected | {(600, 600, 0), (601, 601, 0), (602, 602, 0)}


def test_candidate_pairs_lists_every_pair(spark, tmp_path):
    """A row for each part and each part that it resembles, copies too; the query once gave a row per part with their number."""
    parts = [(k, "blue moon", "LARGE TIN", f"Brand#{1 + k % 2}") for k in range(6)] + [(9, "red sun", "SMALL TIN", "Brand#1"), (10, "blue moon", "LARGE TIN BOX", "Brand#1")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    asked = [(k, f"{kind} {name}") for k, name, kind, _ in parts]
    known = [(k, f"{name} {kind} {brand}") for k, name, kind, brand in parts]
    pairs = text_queries.candidate_pairs(spark, str(tmp_path))
    assert pairs.columns == ["left_key", "right_key", "similarity"]
    assert found(pairs) == all_pairs(asked, known, 0.75, "dice")
    assert pairs.where("left_key < 6 and right_key < 6").count() == 36


def test_candidate_turns_lists_every_pair(spark, tmp_path):
    """A row for each two turns of similar words, copies too; the query once gave a row per turn with their number."""
    turns = [(c, t, "user", "one two three four" if c < 4 else f"one two three x{c}") for c in range(6) for t in range(2)]
    turns += [(7, 0, "user", ""), (8, 0, "user", None), (9, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    keyed = [(f"{c:08d}-{t:04d}", text) for c, t, _, text in turns]
    pairs = text_queries.candidate_turns(spark, str(tmp_path))
    assert pairs.columns == ["left_key", "right_key", "similarity"]
    assert found(pairs) == all_pairs(keyed, None, 0.4, "jaccard")
    assert pairs.where("similarity = 1").count() == 28 + 1 + 1


def test_pairs_that_are_not_similar_stay_in_their_task(spark, monkeypatch):
    """Sets of 20 of 60 words share a rare one with nearly every other; each such pair was written with its words."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.sample([f"v{i}" for i in range(60)], 20))) for k in range(400)]
    met, paired = [], similar._paired

    def counted(*args):
        out = paired(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(similar, "_paired", counted)
    expected = all_pairs(rows, None, 0.45, "jaccard")
    assert 0 < len(expected) < 1000
    assert found(similar.similar_pairs(spark.createDataFrame(rows, "k long, t string"), None, "k", "t", 0.45)) == expected
    assert sum(met) == len(expected)


@pytest.mark.parametrize("least", ["0.4", "0.75", "1"])
@pytest.mark.parametrize("own", [True, False])
def test_blocks_in_small_steps(monkeypatch, least, own):
    """Sets of up to 700 tokens, more than a mark has bits, and steps that end within a set's tokens."""
    for name in ("MET_PER_STEP", "FLAGS_PER_STEP", "TOKENS_PER_STEP"):
        monkeypatch.setattr(overlap, name, 97)
    rng, t = random.Random(2), Fraction(least)
    sets = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(120)]
    sets += [sorted(rng.sample(range(1000), n)) for n in (650, 700, 700)] + [sets[0], [5], [5]]
    part = [0 if own else k % 2 for k in range(len(sets))]
    made = {"cell": [7] * len(sets), "part": part, "id": [b"%d" % k for k in range(len(sets))], "tokens": pa.array(sets, pa.list_(pa.int32()))}
    batches = pa.table(made).to_batches(max_chunksize=50)
    out = [row for b in overlap.overlapping(t, frozenset([7] if own else []))(iter(batches)) for row in b.to_pylist()]
    have = sorted((*(sorted if own else tuple)((int(r["a"]), int(r["b"]))), r["both"], r["total"]) for r in out)
    expected = []
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len({*x} & {*y})
            if (i < j if own else part[i] < part[j]) and both >= t * (len(x) + len(y) - both):
                expected.append((i, j, both, len(x) + len(y)))
    assert have == sorted(expected)
