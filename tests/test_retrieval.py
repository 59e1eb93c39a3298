import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termbridge.operators import assign, retrieval
from termbridge.operators.candidates import merge_candidates
from termbridge.plans import mapping


def brute(q, x, k):
    """(query, code, rank) by full sort, equal scores to the lower code."""
    out = set()
    for i, v in enumerate(q):
        s = np.einsum("j,ij->i", v, x)
        order = sorted(range(len(x)), key=lambda c: (-s[c], c))[:k]
        out |= {(i, c, r) for r, c in enumerate(order, start=1)}
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (300, 12)) / 4
    x[100:200] = x[100]  # a third of the universe is one vector
    q = np.r_[rng.integers(-2, 3, (40, 12)) / 4, np.zeros((1, 12)), x[100:102]]
    queries = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(q)], "query_id int, vec array<double>")
    universe = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "code int, embedding array<double>")
    return q, x, queries.repartition(3), universe.repartition(4)


@pytest.mark.parametrize("search", [{}, {"block_bytes": 4000}, {"block_bytes": 900}])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_topk_equals_full_sort(vectors, search, k):
    q, x, queries, universe = vectors
    found = retrieval.topk_inner_product(queries, universe, k, **search).collect()
    assert {(r.query_id, r.code, r["rank"]) for r in found} == brute(q, x, k)


def test_queries_stream_past_blocks(vectors):
    """One shuffle of the queries while the universe fits a part, nothing broadcast or collected, no join."""
    _, _, queries, universe = vectors
    one = retrieval.topk_inner_product(queries, universe, 3)._jdf.queryExecution().executedPlan().toString()
    many = retrieval.topk_inner_product(queries, universe, 3, block_bytes=4000)._jdf.queryExecution().executedPlan().toString()
    for text, windows in ((one, 0), (many, 1)):
        assert not any(x in text for x in ("CoGroup", "Cartesian", "NestedLoop", "Broadcast", "Join"))
        assert text.count("Window ") == windows


@pytest.mark.parametrize("waiting", [0, 50, 1 << 18])
def test_held_queries_keep_their_best_whatever_is_ranked_between(vectors, monkeypatch, waiting):
    q, x, _, _ = vectors
    monkeypatch.setattr(retrieval, "NOTED_ROWS", waiting)
    asked = pa.table({"id": range(len(q)), "k": [i % 9 + 1 for i in range(len(q))], "vec": list(map(list, q))})
    held = retrieval._Held(asked, ["id"])
    order = np.random.default_rng(2).permutation(len(x))
    for at in range(0, len(x), 17):
        codes = order[at : at + 17]
        held.meet(pa.table({"code": [f"{c:03d}" for c in codes], "vec": [list(x[c]) for c in codes]}))
    found = pa.Table.from_batches(list(held.found())).to_pylist()
    best = {(i, c, r) for i, c, r in brute(q, x, 9) if r <= i % 9 + 1}
    assert {(r["id"], int(r["code"]), r["rank"]) for r in found} == best


def test_small_blocks_do_not_multiply_what_is_sent():
    """The queries went to as many parts as there are blocks; now lanes and parts follow the tasks."""
    for n in (1_000, 100_000, 10_000_000):
        lanes, parts = retrieval._grid(48, n * 512, n * 576, n * 320)
        sent = lanes * n * 512 + parts * n * 896
        assert lanes * parts >= 48 and sent < 25 * n * 896 * max(1, n * 4e-6)
    assert retrieval._grid(48, 6 << 30, 200 * 2112, 200 * 20 * 32) == (1, 192)


def test_k_per_query(vectors):
    q, x, queries, universe = vectors
    sized = queries.withColumn("size", F.col("query_id") % 3)
    for search in ({}, {"block_bytes": 4000}):
        found = retrieval.topk_inner_product(sized, universe, F.col("size"), **search)
        n = {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()}
        assert n == {i: i % 3 for i in range(len(q)) if i % 3}


def test_empty_universe_and_no_variants(vectors):
    _, _, queries, universe = vectors
    assert retrieval.topk_inner_product(queries, universe.filter("code < 0"), 3).isEmpty()
    variants = queries.select(F.lit(1).alias("record_id"), F.col("query_id").alias("variant"), "vec")
    assert retrieval.multi_query_topk(variants.filter("variant < 0"), universe, 3).isEmpty()


def test_merge_by_best_score(spark):
    scores = [0.4821, 0.7899, 0.7654, 0.6892, 0.7234, 0.8012]
    rows = [(1, i, "A64", s) for i, s in enumerate(scores)] + [(1, 0, "B99", 0.6), (1, 1, "B99", 0.6)]
    found = spark.createDataFrame(rows, "record_id int, variant int, code string, score double")
    best = retrieval.merge_by_best_score(found, ["record_id"], 10).orderBy("rank").collect()
    assert [(r.code, r.score, r.best_variant, r["rank"]) for r in best] == [
        ("A64", 0.8012, 5, 1),
        ("B99", 0.6, 0, 2),
    ]


def test_merged_score_is_never_below_a_variant(vectors):
    _, _, queries, universe = vectors
    variants = queries.select((F.col("query_id") % 4).alias("record_id"), F.col("query_id").alias("variant"), "vec")
    single = retrieval.topk_inner_product(variants, universe, 5, ["record_id", "variant"])
    merged = retrieval.multi_query_topk(variants, universe, 5, cut=False)
    joined = single.join(merged.select("record_id", "code", F.col("score").alias("best")), ["record_id", "code"])
    assert joined.count() == single.count() and joined.filter("best < score").isEmpty()


def test_merge_candidates(spark):
    records = spark.createDataFrame(
        [(1, [("A", "given"), ("X", "own"), ("Y", None), ("A", "again")]), (2, [])],
        "record_id int, direct_candidates array<struct<code:string,name:string>>",
    )
    found = spark.createDataFrame(
        [(1, "B", 0.9, 1), (1, "A", 0.8, 2), (1, "Z", 0.7, 3), (2, "A", 0.5, 1)],
        "record_id int, code string, score double, rank int",
    )
    universe = spark.createDataFrame([("A", "Name A"), ("B", "Name B")], "code string, name string")
    rows = merge_candidates(records, found, universe).orderBy("record_id", "pos").collect()
    assert [(r.record_id, r.pos, r.code, r.name, r.source, r.score) for r in rows] == [
        (1, 1, "A", "Name A", "direct", None),
        (1, 2, "X", "own", "direct", None),
        (1, 3, "Y", "", "direct", None),
        (1, 4, "B", "Name B", "retrieved", 0.9),
        (2, 1, "A", "Name A", "retrieved", 0.5),
    ]


def test_overlaps_stay_direct(spark):
    """4 direct and 40 retrieved with 3 in common give 41, of which 37 are retrieved."""
    direct = [(f"C{i}", f"given {i}") for i in (2, 90, 17, 33)]
    records = spark.createDataFrame(
        [(1, direct)], "record_id int, direct_candidates array<struct<code:string,name:string>>"
    )
    found = spark.createDataFrame(
        [(1, f"C{i}", 1.0 - i / 100, i + 1) for i in range(40)],
        "record_id int, code string, score double, rank int",
    )
    names = [(f"C{i}", f"name {i}") for i in range(100)]
    universe = spark.createDataFrame(names, "code string, name string")
    rows = merge_candidates(records, found, universe).orderBy("pos").collect()
    assert [r.code for r in rows[:4]] == ["C2", "C90", "C17", "C33"]
    assert len(rows) == len({r.code for r in rows}) == 41
    retrieved = [r.score for r in rows if r.source == "retrieved"]
    assert len(retrieved) == 37 and retrieved == sorted(retrieved, reverse=True)
    assert all(r.score is None for r in rows if r.source == "direct")


def test_dictionary(spark):
    records = spark.createDataFrame([(1, "Other VENEREAL diseases"), (2, "Cold"), (3, "flu and venereal")], "record_id int, name string")
    entries = spark.createDataFrame(
        [("venereal", 1, 0, "STD"), ("venereal", 1, 1, "STI"), ("flu", 2, 0, "influenza")],
        "trigger string, trigger_pos int, pos int, synonym string",
    )
    concat = retrieval.dictionary_expand(records, entries, "concat")
    assert {(r.record_id, r.text) for r in concat.collect()} == {
        (1, "Other VENEREAL diseases | STD | STI"),
        (2, "Cold"),
        (3, "flu and venereal | STD | STI | influenza"),
    }
    multi = retrieval.dictionary_expand(records, entries, "multi")
    assert {(r.record_id, r.variant, r.text) for r in multi.collect()} == {
        (1, 0, "Other VENEREAL diseases"), (1, 1, "STD"), (1, 2, "STI"), (2, 0, "Cold"),
        (3, 0, "flu and venereal"), (3, 1, "STD"), (3, 2, "STI"),
    }


def test_odd_triggers(spark):
    """An empty trigger, a null name, and a name that grows when lower-cased."""
    records = spark.createDataFrame([(1, "İİİİ cold"), (2, ""), (3, None), (4, "co")], "record_id int, name string")
    entries = spark.createDataFrame(
        [("COLD", 2, 0, "flu"), ("", 1, 0, "any"), (None, 0, 0, "none")],
        "trigger string, trigger_pos int, pos int, synonym string",
    )
    concat = retrieval.dictionary_expand(records, entries, "concat").collect()
    assert {r.record_id: r.text for r in concat} == {1: "İİİİ cold | any | flu", 2: " | any", 3: "", 4: "co | any"}


def test_rows_with_equal_ids_are_searched_one_by_one(vectors):
    q, x, queries, universe = vectors
    same = queries.withColumns({"size": F.col("query_id") % 3, "query_id": F.when(F.col("query_id") > 5, 1)})
    found = [
        retrieval.topk_inner_product(same, universe, F.col("size"), **search).collect()
        for search in ({}, {"block_bytes": 4000})
    ]
    assert len(found[0]) == sum(i % 3 for i in range(len(q)))
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))


def test_strategies_find_by_synonym(spark):
    universe = spark.createDataFrame(
        [("A64", "Unspecified sexually transmitted disease"), ("B99", "Other infectious diseases"), ("J11", "Influenza")],
        "code string, name string",
    ).withColumns({"synonyms": F.array().cast("array<string>"), "description": F.lit(None).cast("string")})
    model, embedded = mapping.embed_universe(universe, 1024)
    records = spark.createDataFrame([(1, "099", "Other venereal diseases")], "record_id int, code string, name string")
    entries = spark.createDataFrame(
        [("venereal", 0, 0, "sexually transmitted disease")], "trigger string, trigger_pos int, pos int, synonym string"
    )
    targets = spark.createDataFrame([(1, "A64"), (1, "none")], "record_id int, target string")
    rows = mapping.diagnose_strategies(records, embedded, entries, model, targets, 1).collect()
    ranks = {(r.strategy, r.target): r["rank"] for r in rows}
    assert ranks["multi_query", "A64"] == 1 and ranks["name_only", "A64"] == -1
    assert ranks["large_k_5x", "A64"] > 0 and ranks["baseline", "none"] == -1


def best_total(edges):
    """Largest total of a one-to-one choice, by trying all."""
    by_query = {}
    for q, d, s in edges:
        by_query.setdefault(q, [(None, 0.0)]).append((d, s))
    best = 0.0
    for choice in itertools.product(*by_query.values()):
        docs = [d for d, _ in choice if d is not None]
        if len(docs) == len(set(docs)):
            best = max(best, sum(s for _, s in choice))
    return best


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(9)
    rows = []
    for block in range(25):
        n, m = rng.integers(1, 6, 2)
        for q, d in itertools.product(range(n), range(m)):
            if rng.random() < 0.7:
                rows.append((block, int(q), int(d), float(np.round(rng.random() * 1.2 - 0.2, 2))))
    return rows, spark.createDataFrame(rows, "block int, query int, doc int, score double")


@pytest.mark.parametrize(
    "settings,slack",
    [
        ({"eps": 0.001}, 1e-9),  # scores have two digits, so less than 0.01 below is the best
        ({"eps": 0.05}, 0.25),
        ({"eps": 0.02, "list_size": 2, "task_rows": 20}, 0.1),
    ],
)
def test_assignment_against_brute_force(edges, settings, slack):
    rows, df = edges
    chosen = assign.one_to_one_assignment(df, **settings).collect()
    mutual = assign.mutual_best(df.filter("score > 0")).collect()
    given = {(b, q, d): s for b, q, d, s in rows}
    for block in range(25):
        mine = [r for r in chosen if r.block == block]
        assert len({r.query for r in mine}) == len({r.doc for r in mine}) == len(mine)
        assert all(given[block, r.query, r.doc] == r.score > 0 for r in mine)
        best = best_total([(q, d, s) for b, q, d, s in rows if b == block and s > 0])
        total = sum(r.score for r in mine)
        assert best - slack <= total <= best + 1e-9
        assert total >= sum(r.score for r in mutual if r.block == block) - slack


def test_assignment_bound(edges):
    rows, df = edges
    found = {r.block: r for r in assign.assignment_bound(df, eps=0.02, list_size=2, task_rows=20).collect()}
    assert set(found) == {b for b, _, _, s in rows if s > 0}
    for block, r in found.items():
        best = best_total([(q, d, s) for b, q, d, s in rows if b == block and s > 0])
        assert r.total <= best + 1e-9 and best <= r.bound + 1e-9 and r.within
        assert r.repeated_queries == r.repeated_docs == r.unknown_edges == 0


def test_isotonic_scores_lie_between_0_and_1(spark):
    from termbridge.operators import models

    rows = spark.createDataFrame([(0.2, 0), (0.7, 1), (1.5, 1)], "score double, y int")
    fitted = models.fit_isotonic(rows.filter("score <= 1"), "y")
    assert [r.calibrated for r in fitted.transform(rows.filter("score <= 1")).orderBy("score").collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="must lie in"):
        models.fit_isotonic(rows, "y")
