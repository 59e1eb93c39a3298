from pyspark.sql import functions as F

from termbridge.functions import similarity, text


def cells(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, cell string")


def parsed(df, column):
    rows = df.select("id", column.alias("c")).orderBy("id").collect()
    return [[(c["code"], c["name"]) for c in r["c"]] for r in rows]


def test_pipe_cells(spark):
    df = cells(
        spark, [None, "", " ", "C1", "C1|C2", "C1:A|C2:B", "C1:A: b| C2 ||", "C : N\t", ":x"]
    )
    assert parsed(df, text.parse_pipe_candidates(F.col("cell"))) == [
        [],
        [],
        [],
        [("C1", None)],
        [("C1", None), ("C2", None)],
        [("C1", "A"), ("C2", "B")],
        [("C1", "A: b"), ("C2", None)],
        [("C", "N")],
        [("", "x")],
    ]


def test_tagged_cells(spark):
    values = [
        None,
        "C1",
        "icd10_code:C1:PHENONAME:N",
        "ICD10_code:C1",
        "phenoname:N",
        "ICD10_code:C1:phenoname:a: b",
        "ICD10_code:C1:ICD10_code:C2:phenoname:N",
        "ICD10_code:C1:phenoname",
        "ICD10_code:C1:phenoname:N | x:y | ICD10_code:C2:phenoname:M",
    ]
    df = cells(spark, values)
    assert parsed(df, text.parse_tagged_candidates(F.col("cell"))) == [
        [],
        [],
        [("C1", "N")],
        [("C1", None)],
        [],
        [("C1", "a")],
        [("C2", "N")],
        [("C1", None)],
        [("C1", "N"), ("C2", "M")],
    ]
    kept = parsed(df, text.parse_tagged_candidates(F.col("cell"), keep_colons=True))
    assert kept[5] == [("C1", "a: b")]
    assert kept[2] == [("C1", "N")] and kept[3] == [("C1", None)]


def test_search_and_variants(spark):
    df = spark.createDataFrame(
        [("A1", "n", ["s", "t"], "d"), ("A2", "m", [], ""), ("A3", "k", None, None)],
        "code string, name string, synonyms array<string>, description string",
    )
    joined = text.search_text(*[F.col(c) for c in df.columns])
    assert [r[0] for r in df.select(joined).collect()] == ["A1 | n | s | t | d", "A2 | m", "A3 | k"]
    names = spark.createDataFrame([("n", [" a ", "", None, "a", "n"])], "name string, s array<string>")
    row = names.select(
        text.query_variants(F.col("name"), F.col("s")),
        text.query_variants(F.col("name"), F.col("s"), include_original=False),
    ).first()
    assert row[0] == ["n", "a", "a", "n"] and row[1] == ["a", "a", "n"]


def test_synonym_answers(spark):
    df = cells(spark, ['{"synonyms": [" a ", "", "b"]}', "no", '{"x": 1}', None, "[]"])
    rows = df.select(text.clean_synonyms(F.col("cell"))).collect()
    assert [r[0] for r in rows] == [["a", "b"], [], [], [], []]


def test_pair_similarities(spark):
    df = spark.createDataFrame(
        [("Acute viral hepatitis", "viral hepatitis, acute"), ("", ""), ("abc", "abd"), ("a b", "c")],
        "a string, b string",
    )
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        similarity.jaccard_tokens(a, b), similarity.dice_tokens(a, b), similarity.levenshtein_ratio(a, b)
    ).collect()
    assert [r[0] for r in rows] == [1.0, 0.0, 0.0, 0.0]
    assert [r[1] for r in rows] == [1.0, 0.0, 0.0, 0.0]
    assert rows[1][2] == 1.0 and abs(rows[2][2] - 2 / 3) < 1e-12 and rows[3][2] == 0.0


def test_dot_products_and_norms(spark):
    df = spark.createDataFrame(
        [([0.5, 0.3, -0.2, 0.1], [0.52, 0.29, -0.19, 0.11]), ([0.5, 0.3, -0.2, 0.1], [0.1, -0.4, 0.5, -0.2])],
        "a array<double>, b array<double>",
    )
    dots = [r[0] for r in df.select(similarity.inner_product(F.col("a"), F.col("b"))).collect()]
    assert [round(d, 4) for d in dots] == [0.396, -0.19]
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    unit = zero.select(similarity.l2_normalize(F.col("v"))).collect()
    assert [list(r[0]) for r in unit] == [[0.0, 0.0], [0.6, 0.8]]
    same = zero.select(similarity.cos_similarity(F.col("v"), F.col("v"))).collect()
    assert [r[0] for r in same] == [0.0, 1.0]


def test_parsers_work_on_streams(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    cells(spark, ["C1:A|C2", None]).write.parquet(source)
    stream = spark.readStream.schema("id int, cell string").parquet(source)
    made = stream.select("id", F.size(text.parse_pipe_candidates(F.col("cell"))).alias("n"))
    query = (
        made.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()
    assert {(r["id"], r["n"]) for r in spark.read.parquet(sink).collect()} == {(0, 2), (1, 0)}


def test_tagged_cells_are_split_once(spark):
    """The tokens of an entry were made again for every use of them."""
    cells = spark.createDataFrame([("ICD10_code:A:phenoname:N: x | phenoname:none | icd10_CODE: B :phenoname:",)], "cell string")
    for kept, names in ((False, ["N", ""]), (True, ["N: x", ""])):
        read = cells.select(text.parse_tagged_candidates(F.col("cell"), keep_colons=kept).alias("c"))
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(", :, -1)") == 1
        assert [(c.code, c.name) for c in read.first().c] == list(zip("AB", names))
