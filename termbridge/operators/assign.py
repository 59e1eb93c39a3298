"""One-to-one assignment: every query and every doc used at most once per block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termbridge.operators.skew import first_rows
from termbridge.session import cut_lineage


def mutual_best(edges: DataFrame) -> DataFrame:
    """Edges (block, query, doc, score) that are the best of both their query and their doc."""
    best = F.col("score").desc()
    for_query = first_rows(edges, ["block", "query"], [best, F.col("doc").asc()])
    for_doc = first_rows(edges, ["block", "doc"], [best, F.col("query").asc()])
    return for_query.join(
        for_doc.select("block", "query", "doc"), ["block", "query", "doc"], "left_semi"
    )


def _bid(listed: pd.DataFrame, size: int, eps: float) -> pd.DataFrame:
    """Let the queries of one task bid until each has a doc or finds none worth its price.

    Rows are the best edges of a block's queries at the prices so far. Row ``size + 1``
    of a query, if there is one, is not bid on: no unlisted doc is worth more than it,
    so a query whose listed docs fall below that value waits for a new list.
    """
    listed = listed.sort_values(["query", "at"], ignore_index=True)
    docs, doc = np.unique(listed["doc"].to_numpy(), return_inverse=True)
    first = np.flatnonzero(listed["at"].to_numpy() == 1)
    ends = np.append(first[1:], len(listed))
    at, score = listed["at"].to_numpy(), listed["score"].to_numpy()
    price = np.zeros(len(docs))
    price[doc] = listed["price"].to_numpy()
    owner = np.full(len(docs), -1)
    own = listed["own"].to_numpy()
    lists, floors = [], []
    for i, (begin, end) in enumerate(zip(first, ends)):
        cut = at[end - 1] > size
        floors.append(max(0.0, score[end - 1] - price[doc[end - 1]]) if cut else 0.0)
        lists.append((doc[begin : end - cut], score[begin : end - cut]))
        if own[begin]:
            owner[doc[begin]] = i
    free = [i for i, begin in enumerate(first) if not own[begin]]
    while free:
        i = free.pop()
        wanted, worth = lists[i]
        net = worth - price[wanted]
        best = int(np.argmax(net))
        value = net[best]
        net[best] = floors[i]
        second = max(floors[i], float(net.max()))
        if value <= 0.0 or value < floors[i]:
            continue
        taken = wanted[best]
        price[taken] += value - second + eps
        if owner[taken] >= 0:
            free.append(int(owner[taken]))
        owner[taken] = i
    held = np.flatnonzero(owner >= 0)
    return pd.DataFrame(
        {
            "block": listed["block"].to_numpy()[first[owner[held]]],
            "query": listed["query"].to_numpy()[first[owner[held]]],
            "doc": docs[held],
            "price": price[held],
        }
    )


def _auction(edges: DataFrame, eps: float, size: int, task_rows: int) -> DataFrame:
    """Docs that are held and their prices: (block, query, doc, price), by rounds of bids.

    In each round every query brings its ``size`` best edges at the present prices.
    A block of at most ``task_rows`` such rows is one task's work, which settles it but
    for queries that need a longer list; the queries of a larger block are spread
    over several tasks, differently each time. A task bids for its queries as if
    alone; of the tasks that want a doc, the highest bid takes it. Prices only rise, so
    a holder that was not outbid stays within ``eps`` of its best doc, and so does the
    total per query. Each round's lists and holders are written out. The last round
    has no query left that is without a doc and has one worth its price.
    """
    keys = ["block", "doc"]
    schema = T.StructType(
        [edges.schema[c] for c in ("block", "query", "doc")] + [T.StructField("price", T.DoubleType())]
    )

    def bid(part: pd.DataFrame) -> pd.DataFrame:
        return _bid(part, size, eps)

    held = edges.sparkSession.createDataFrame([], schema)
    turn = 0
    while True:
        holders = held.select(*keys, "price", F.col("query").alias("holder"))
        own = F.coalesce(F.col("holder") == F.col("query"), F.lit(False))
        priced = edges.join(holders, keys, "left").select(
            "block",
            "query",
            "doc",
            "score",
            F.coalesce("price", F.lit(0.0)).alias("price"),
            own.alias("own"),
        )
        net = F.col("score") - F.col("price")
        order = [F.col("own").desc(), net.desc(), F.col("doc").asc()]
        open_edges = priced.filter(F.col("own") | (net > 0))
        listed = cut_lineage(first_rows(open_edges, ["block", "query"], order, size + 1, "at"))
        state = listed.filter("at = 1").agg(F.count_if(~F.col("own")).alias("free")).first()
        if not state["free"]:
            break
        rows = listed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        parts = rows.select("block", F.ceil(F.col("n") / task_rows).alias("parts"))
        part = F.pmod(F.xxhash64("query", F.lit(turn)), F.col("parts")).alias("part")
        tasks = listed.join(parts, "block").withColumn("part", part)
        bids = tasks.groupBy("block", "part").applyInPandas(bid, schema)
        held = cut_lineage(
            bids.groupBy(*keys)
            .agg(
                F.max("price").alias("price"),
                F.min_by("query", F.struct(-F.col("price"), F.col("query"))).alias("query"),
            )
            .select("block", "query", "doc", "price")
        )
        turn += 1
    return held


def _positive(edges: DataFrame) -> DataFrame:
    """Each pair once with its best score, if that is above 0."""
    edges = edges.select("block", "query", "doc", "score").filter(F.col("score") > 0)
    return cut_lineage(edges.groupBy("block", "query", "doc").agg(F.max("score").alias("score")))


def one_to_one_assignment(
    edges: DataFrame, eps: float = 0.01, list_size: int = 64, task_rows: int = 4_000_000
) -> DataFrame:
    """Edges (block, query, doc, score) of high total score with no query or doc twice.

    The total of a block is at most ``eps`` per query below the highest there is, whatever
    the size of the block; so it is the highest if totals differ by more than that.
    Edges that score 0 or less are never chosen, and pairs without an edge cannot be.
    """
    edges = _positive(edges)
    held = _auction(edges, eps, list_size, task_rows)
    return edges.join(held.select("block", "query", "doc"), ["block", "query", "doc"], "left_semi")


def assignment_bound(
    edges: DataFrame, eps: float = 0.01, list_size: int = 64, task_rows: int = 4_000_000
) -> DataFrame:
    """Per block, what the assignment reaches and what no assignment can exceed.

    The prices bound every assignment's total: it is at most the sum of all prices and of each
    query's best score above the price (0 if none is). Returns block, n_queries, repeated_queries,
    repeated_docs, unknown_edges, total, bound and within (total >= bound - eps * n_queries).
    """
    edges = _positive(edges)
    held = _auction(edges, eps, list_size, task_rows)
    chosen = held.join(edges, ["block", "query", "doc"], "left")
    uses = chosen.groupBy("block").agg(
        F.sum("price").alias("prices"),
        F.sum("score").alias("total"),
        F.count_if(F.col("score").isNull()).alias("unknown_edges"),
    )
    repeated = [
        chosen.groupBy("block", side).agg((F.count(F.lit(1)) - 1).alias("n"))
        .groupBy("block").agg(F.sum("n").alias(name))
        for side, name in (("query", "repeated_queries"), ("doc", "repeated_docs"))
    ]
    net = F.col("score") - F.coalesce("price", F.lit(0.0))
    priced = edges.join(held.select("block", "doc", "price"), ["block", "doc"], "left")
    best = priced.groupBy("block", "query").agg(F.greatest(F.max(net), F.lit(0.0)).alias("net"))
    blocks = best.groupBy("block").agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("n_queries"))
    bound = F.col("net") + F.col("prices")
    # The margin covers the rounding of the sums.
    within = F.col("total") >= F.col("bound") - F.col("n_queries") * (eps + 1e-9)
    return (
        blocks.join(uses, "block").join(repeated[0], "block").join(repeated[1], "block")
        .withColumn("bound", bound)
        .select(
            "block", "n_queries", "repeated_queries", "repeated_docs", "unknown_edges", "total", "bound",
            within.alias("within"),
        )
    )
