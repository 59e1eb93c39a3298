import itertools
import random

import duckdb
import pytest
from check_oracle import compare

from termbridge.llm import licenses


def scanned(spark, texts, **tables):
    rows = licenses.find_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **tables)
    return [tuple(r)[1:] for r in sorted(rows.collect())]


def test_named_licences(spark):
    texts = [
        "a\nLicensed under the Mozilla Public License, Version 2.0\nb",
        "<div><p class=x>Released under the MIT License</p></div>",
        "<!-- Distributed under the Boost Software License 1.0 -->",
        "x SPDX-License-Identifier: MIT",
        "# SPDX-License-Identifier: AGPL-3.0-or-later",
        "This project is licensed under the GNU Lesser General Public License v2.1.",
    ]
    assert [r[2] for r in scanned(spark, texts)] == ["MPL-2.0", "MIT", "BSL-1.0", "", "AGPL-3.0", "LGPL-2.1"]
    assert len(licenses.LICENCES) >= 40


def test_rules_take_neighbours_only(spark):
    first = {k: v[0] for k, v in licenses.SENTENCES.items()}
    texts = [".\n".join(first[k] for k in ("name-apache-2.0", "isc-grant", "apache-limits", "apache-where"))]
    assert scanned(spark, texts) == [
        (4, "name-apache-2.0,isc-grant,apache-limits,apache-where", "ISC AND Apache-2.0", "apache-limits apache-where")
    ]


def test_tables_are_arguments(spark):
    own = {"sentences": {"x": ["You may eat it"], "y": ["You may drink it"]}, "rules": [("Food", ["x", "y"]), ("Drink", ["y"])]}
    assert scanned(spark, ["You may eat it. You may drink it.", "you MAY drink it", "You may eat it"], **own) == [
        (2, "x,y", "Food", ""),
        (1, "y", "Drink", ""),
        (1, "x", "", "x"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_sentences_against_sql(spark, seed):
    """Sentences in random order, wrapped at random words, between marks and other words of all kinds."""
    rng = random.Random(seed)
    wordings = [w for v in licenses.SENTENCES.values() for w in v]
    sequences = [[licenses.SENTENCES[k][0] for k in seq] for _, seq in licenses.RULES if len(seq) > 1]
    marks = [". ", "\n", "|", "<br>", "\r\n", "; ", ":\t", " \n\n ", " ", " ", " - ", "</p><p>"]

    def wrapped(sentence):
        return " ".join(w + rng.choice(["", "", "", "", "\n//"]) for w in sentence.split(" "))

    texts = [None, "", "|\n.", "licensed under the"]
    for _ in range(300):
        said = list(itertools.chain.from_iterable(rng.choice([[rng.choice(wordings)], rng.choice(sequences), ["bla bla"]]) for _ in range(rng.randint(1, 5))))
        texts.append("".join(rng.choice(marks) + wrapped(s) for s in said) + rng.choice(["", "\n", ".", "!"]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = licenses.find_licences(frame)
    assert compare(found, con, licenses.SQL) is None
    assert found.where("licences like '%AND%'").count() > 30
