import base64
import collections
import hashlib
import html.parser
import math
import re
import urllib.parse

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from check_oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from termbridge.llm import (
    arrays,
    blocks,
    bloom_lm,
    byte_bpe,
    cells,
    embedding_dedup,
    exact_dedup,
    language,
    licenses,
    line_dedup,
    minhash,
    mixing,
    queries,
    url_filter,
)
from termbridge.llm.components import connected_components

RANKS = byte_bpe.read_ranks(queries.RANKS)
ENCODING = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) is None


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["A b\x0bC", None, "", "  x  ", "c B a b c d", "é\u00a0é a"]
    hashes, rows, _ = arrays.words(*arrays.flat(pa.array(texts)))
    expected = [(k, w) for k, t in enumerate(texts) for w in plain.WORD.findall(plain.lower(t))]
    assert rows.tolist() == [k for k, _ in expected]
    assert len(set(hashes.tolist())) == len({w for _, w in expected})
    found, offsets = arrays.shingles(hashes, rows, len(texts), 5)
    assert np.diff(offsets).tolist() == [1, 0, 0, 1, 2, 1]


def test_pack():
    for x in ([], [0], [1, 255, 256, 1 << 40]):
        assert blocks.unpack(blocks.pack(np.array(x, np.int64))).tolist() == x


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (103, 102), (None, 5), (7, 7), (101, 103)]
    edges = spark.createDataFrame(chain, "a long, b long")
    expected = plain.components([*range(61), *range(100, 104)], [(a, b) for a, b in chain if a is not None])
    assert dict(pairs(connected_components(edges))) == expected
    assert pairs(connected_components(edges.where("false"))) == []


# 1


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 8))
    rows = [(k, (base[k % 40] + 0.08 * rng.standard_normal(8)).tolist()) for k in range(200)]
    rows += [(k, base[0].tolist()) for k in range(200, 240)] + [(250, (3 * base[0]).tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8), (305, [1.0] * 3), (306, [2.0] * 3)]
    rows += [(307, [float("inf")] + [0.0] * 7), (308, [1e200] * 8), (309, [-1e200] * 8)]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_against_all_pairs(spark, block):
    rows = vectors(spark)
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.linked_vectors(given, block=block).collect()}
    assert got == plain.vector_links(rows)
    kept = embedding_dedup.linked_vectors(given.where("vec_id >= 200"), block=block)
    assert {r.vec_id for r in kept.where("kept").collect()} == {200, *range(300, 306), 307, 308, 309}
    assert embedding_dedup.linked_vectors(given.where("false")).collect() == []
    lost = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(pairs(embedding_dedup.linked_vectors(lost)), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


def test_vector_plan():
    assert embedding_dedup.plan(10) == (2, embedding_dedup.plan(10)[1])
    for n in (10_000, 10**6, 10**9):
        depth, tables = embedding_dedup.plan(n)
        near = embedding_dedup.same_slot(embedding_dedup.CELL_WIDTH, math.sqrt(0.1))
        assert 1 - (1 - near**depth) ** tables >= 0.998


# 2


@pytest.mark.parametrize("batches", [1, 7])
def test_lines(spark, odd, documents, batches):
    for df in (documents, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = pairs(df.select("doc_id", "text"))
        done = line_dedup.dedup_lines(df, batches=batches)
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in done.collect()}
        assert got == plain.line_dedup(rows)
        assert done.columns == [*df.columns, *line_dedup.MADE]


def test_lines_odd(odd, empty):
    done = line_dedup.dedup_lines(odd).collect()
    assert len(done) == odd.count()
    assert all(r.n_dropped == 0 and (r.text or "") == (t or "") for r in done for t in [r.text] if r.doc_id is None)
    assert sum(r.text is None for r in done) == 2
    assert line_dedup.dedup_lines(empty).collect() == []


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2)
    gone = [sorted(pairs(runs.add(spark.createDataFrame(x, "doc_id long, high long, low long")))) for x in (
        [(1, 5, 5), (2, 5, 5), (2, 6, 6)], [(3, 6, 6), (3, 7, 7)], [(4, 7, 7), (5, 8, 8)], [(6, 8, 8), (7, 5, 5)])]
    assert gone == [[(2, 5, 5)], [(3, 6, 6)], [(4, 7, 7)], [(6, 8, 8), (7, 5, 5)]]
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    hashes = [(r.high, r.first) for r in runs.levels[2][0].collect()]
    assert sorted(hashes) == [(5, 1), (6, 2), (7, 3), (8, 5)]


# 3


@pytest.mark.parametrize("block", [4096, 8])
def test_minhash(documents, block):
    rows = pairs(documents.select("doc_id", "text"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents, block=block).collect()}
    assert got == plain.near_duplicates(rows)


def test_minhash_borders(spark):
    words = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(1)
    rows = [(0, " ".join(words))]
    for k in range(1, 120):  # edits that leave similarities on both sides of the threshold
        own = list(words)
        for p in rng.choice(400, rng.integers(3, 14), replace=False):
            own[p] = f"x{k}_{p}"
        rows.append((k, " ".join(own)))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(given).collect()}
    assert got == plain.near_duplicates(rows)


def test_minhash_odd(odd, empty):
    got = sorted(pairs(minhash.near_duplicates(odd)), key=str)
    by_id = collections.defaultdict(set)
    for i, n, c, kept in got:
        by_id[i].add((n, c, kept))
    assert by_id[4] == {(0, 4, True)} and by_id[12] == {(0, 12, True)}
    assert by_id[6] == {(1, 6, True)} and by_id[7] == {(1, 6, False)} and by_id[8] == {(1, 6, False)}
    assert by_id[None] == {(1, None, True), (0, None, True)}
    assert by_id[11] == {(by_id[10].copy().pop()[0] + 1, 10, False)}
    assert by_id[13] == {(1, 13, True)} and by_id[14] == {(1, 13, False)}
    assert len(got) == odd.count()
    assert minhash.near_duplicates(empty).collect() == []


# 4


def test_automaton_knows_all_substrings():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 60).tolist()
    table = language.automaton(text, 4)
    parts = {tuple(text[a:b]) for a in range(60) for b in range(a + 1, 61)}

    def known(word):
        state = 0
        for s in word:
            state = table[state, s]
            if not state:
                return False
        return True

    assert all(known(p) for p in parts)
    for _ in range(500):
        word = tuple(rng.integers(1, 4, rng.integers(1, 8)).tolist())
        assert known(word) == (word in parts)


def test_phrases_against_greedy_parse(monkeypatch):
    monkeypatch.setattr(language, "STRETCH", 16)
    model = language.LanguageModel({"a": "the cat sat on the mat", "b": "der hund lag auf der matte"})
    texts = ["the mat sat", "", "xyz", "der cat lag on the matte " * 5]
    codes, offsets = language.letters_of(texts)
    symbols = model.encode(codes)
    got = model.phrases(symbols, offsets)
    for n, name in enumerate(model.languages):
        sample = bytes(model.encode(language.letters_of([{"a": "the cat sat on the mat", "b": "der hund lag auf der matte"}[name]])[0]))
        for k in range(len(texts)):
            own, count = bytes(symbols[offsets[k] : offsets[k + 1]].astype(np.uint8)), 0
            for piece in (own[x : x + 16] for x in range(0, len(own), 16)):
                at = 0
                while at < len(piece):
                    size = 1
                    while at + size < len(piece) and piece[at : at + size + 1] in sample:
                        size += 1
                    at += size
                    count += 1
            assert got[k, n] == count


def test_language_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    done = queries.op4_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in done]) > 0.97
    assert all(0 <= r.score <= 1 for r in done)
    assert all(r.accepted for r in done)


def test_language_odd(spark, odd, empty):
    model = language.learn(odd)
    done = language.identify(odd.withColumn("score", F.lit("clash")), model)
    rows = done.collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(done.columns)
    assert {(r.lang_pred, r.score, r.accepted) for r in rows if not (r.text or "").strip()} == {("und", 0.0, False)}
    assert language.identify(empty, model).collect() == []
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("dense", [language.DENSE, 0])
def test_language_scripts(spark, monkeypatch, dense):
    monkeypatch.setattr(language, "DENSE", dense)
    spans = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 17), "arabic": (0x628, 19), "hindi": (0x915, 37),
             "korean": (0xAC00, 400), "kana": (0x3042, 80), "han": (0x4E00, 900), "han2": (0x6E00, 900)}
    rng = np.random.default_rng(5)
    words = {k: ["".join(map(chr, first + rng.integers(0, n, 3))) for _ in range(300)] for k, (first, n) in spans.items()}
    rows = [(k * 1000 + n, " ".join(rng.choice(words[name], 12)), name) for k, name in enumerate(words) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.where("doc_id % 1000 < 30"))
    done = language.identify(docs.where("doc_id % 1000 >= 30"), model).collect()
    assert len(done) == 90 and all(r.lang == r.lang_pred and r.accepted for r in done)


def test_language_learns_every_label(spark):
    rows = [(k, f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)} wort", f"l{k:03}") for k in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.learn(docs)
    assert model.languages == [x for _, _, x in rows]
    assert all(r.lang == r.lang_pred for r in language.identify(docs, model).collect())


# 5


def test_licences(spark, odd, empty):
    mit = "Copyright x.\n" + ". ".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "as-is")) + "."
    rows = [(1, mit), (2, "Bla. Licensed under CC BY-NC 4.0.\nBla."), (3, None), (4, licenses.SENTENCES["bsd-source"][0]), (5, "")]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.find_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (3, "mit-grant,mit-notice,as-is", "MIT", "")
    assert got[2] == (1, "name-cc-by-nc-4.0", "CC-BY-NC-4.0", "")
    assert got[3] == got[5] == (0, "", "", "")
    assert got[4] == (1, "bsd-source", "", "bsd-source")
    assert licenses.find_licences(odd).count() == odd.count() and licenses.find_licences(empty).count() == 0


def test_licences_on_own_lines(spark):
    name, short = "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0"
    wrapped = "# Redistributions of source code must retain the above copyright\n# notice, this list of conditions\r\n#   and the following disclaimer"
    texts = [f"end.***\n{name}", f"| a |\n{name}\nb", f"| a | {name} | b |", f"- a\n- {name}\n- b", f"x = 1\n// {name}\ny = 2", f"a\n## {name}\nb",
             f"a\n{wrapped}\nb", f'a\n{short} (the "License")\nb', f"a\n{name}\n{name}\n{short}", f"It is not {name} Bla", f"a\nnot {name}"]
    cc, apache = "name-cc-by-nc-4.0", "name-apache-2.0"
    expected = [cc] * 6 + ["bsd-source", apache, f"{cc},{cc},{apache}", "", ""]
    rows = licenses.find_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.sentence_ids for r in sorted(rows)] == expected


def test_licences_every_sentence_and_rule(spark):
    wordings = [(k, f"Bla.\n{x}.\nBla. {x};\nbla\n{x}") for k, v in licenses.SENTENCES.items() for x in v]
    rules = [(name, ".\n\n".join(licenses.SENTENCES[k][0] for k in seq)) for name, seq in licenses.RULES]
    texts = [t for _, t in wordings + rules] + ["/*\n * SPDX-License-Identifier: MIT\n */"]
    rows = sorted(licenses.find_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r.sentence_ids for r in rows[: len(wordings)]] == [",".join([k] * 3) for k, _ in wordings]
    assert [(r.licences, r.unmatched) for r in rows[len(wordings) : -1]] == [(name, "") for name, _ in rules]
    assert tuple(rows[-1])[1:] == (1, "spdx-mit", "MIT", "")


# 6


def test_lm(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = documents.withColumn("train", queries.fold(7) != 2)
    rows = pairs(given.select("doc_id", "text", "train"))
    tokens = {i: [*plain.WORD.findall(plain.lower(t)), None] for i, t, _ in rows}
    counts = collections.Counter(w for i, _, train in rows if train for w in tokens[i])
    mass = sum(counts.values()) + len(counts) + 1
    done = bloom_lm.score_texts(given, "train").collect()
    assert len(done) == len(rows)
    for r in done:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), sum(counts.values()))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / mass) for w in own), rel=1e-9)
    held = [r for r in done if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the model beats single words


def plain_scores(rows):
    """Scores of (text, train) by the docstring's formula, every bigram's count known as a power of two."""
    tokens = [[None, *plain.WORD.findall(plain.lower(t or "")), None] for t, _ in rows]  # None: the end of a text
    learned = [(before, w) for own, (_, train) in zip(tokens, rows) if train for before, w in zip(own, own[1:])]
    single, both = collections.Counter(w for _, w in learned), collections.Counter(learned)
    mass = len(learned) + len(single) + 1
    levels = {pair: n.bit_length() for pair, n in both.items()}

    def counted(before, w):
        level = levels.get((before, w), 0)
        return min(0.75 * 2**level - 0.5 if level else 0, single[before], single[w])

    kind = lambda before: max(single[before], 1).bit_length() - 1
    sums = collections.defaultdict(lambda: [0.0] * len(bloom_lm.SHARES))
    for (before, w), n in both.items():
        share = max(counted(before, w) - 1, 0) / max(single[before] - 1, 1)
        for k, s in enumerate(bloom_lm.SHARES):
            sums[kind(before)][k] += n * math.log(s * share + (1 - s) * single[w] / mass)
    best = {k: bloom_lm.SHARES[max(range(len(v)), key=lambda x: (round(v[x], 3), x))] for k, v in sums.items()}

    def score(own):
        out = 0.0
        for before, w in zip(own, own[1:]):
            s = best.get(kind(before), 0.0)
            out += math.log10(s * counted(before, w) / max(single[before], 1) + (1 - s) * (single[w] + 1) / mass)
        return out

    return [score(own) for own in tokens]


@pytest.mark.parametrize("buckets", [1, 37])
def test_lm_scores_against_plain(spark, buckets):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("train", queries.fold(7) != 2)
    rows = pairs(documents.select("doc_id", "text", "train"))
    wanted = dict(zip([i for i, _, _ in rows], plain_scores([r[1:] for r in rows])))
    done = bloom_lm.score_texts(documents, "train", buckets=buckets, bits=200).collect()
    assert {r.doc_id: r.score for r in done} == pytest.approx(wanted, rel=1e-9)
    # The filter of production size takes few unknown bigrams for known ones.
    usual = bloom_lm.score_texts(documents, "train", buckets=buckets).collect()
    assert sum(r.score for r in usual) == pytest.approx(sum(wanted.values()), rel=0.01)


def test_lm_filter():
    hashes = arrays.numbers(4000, 9)
    counts = np.repeat([1, 2, 3, 9], [400, 300, 200, 100])
    filter_ = bloom_lm.CountFilter.of(hashes[:1000], counts)
    got, true = filter_.levels(hashes), np.repeat([1, 2, 2, 4, 0], [400, 300, 200, 100, 3000])
    assert (got >= true).all() and (got == true).mean() > 0.97
    assert bloom_lm.middle(np.arange(5)).tolist() == [0, 1, 2.5, 5.5, 11.5]
    assert not bloom_lm.CountFilter.of(hashes[:0], counts[:0]).levels(hashes).any()


def test_lm_odd(odd, empty):
    given = odd.withColumn("train", F.when(F.col("n_chars") % 2 == 0, F.lit(True)))
    rows = [(r.text, r.train) for r in given.collect()]
    done = bloom_lm.score_texts(given, "train", bits=200).collect()
    assert sorted(r.score for r in done) == pytest.approx(sorted(plain_scores(rows)), rel=1e-9)
    untaught = bloom_lm.score_texts(odd.withColumn("train", F.lit(False)), "train").collect()
    assert all(r.base_score == r.score == 0 and r.n_known == r.train_tokens == 0 for r in untaught)
    assert bloom_lm.score_texts(empty.withColumn("train", F.lit(True)), "train").collect() == []


# 7


def test_bpe(spark, documents, odd, empty):
    for df in (documents, odd):
        texts = collections.Counter((i, t or "") for i, t in pairs(df.select("doc_id", "text")))
        done = byte_bpe.decode_ids(byte_bpe.encode_texts(df, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS)
        got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in done.collect()]
        assert collections.Counter((i, t) for i, _, t in got) == texts
        assert all(ids == ENCODING.encode_ordinary(t) for _, ids, t in got)
    assert byte_bpe.encode_texts(empty, queries.RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_spaces():
    import regex

    split = regex.compile(byte_bpe.own_pattern(public_tokenizers.PATTERN)).findall
    for c in ["\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u180e", "\ufeff", "\r\n", "\u3000"]:
        text = f"a{c}b {c}{c} 1{c}  !{c}"
        ids = [x for w in split(text) for x in ENCODING._core_bpe.encode_single_piece(w.encode())]
        assert ids == ENCODING.encode_ordinary(text)


# 8


def test_fingerprints_combine():
    data = np.random.default_rng(3).integers(0, 256, 300_000).astype(np.uint8)
    for modulus, base in zip(exact_dedup.MODULI, exact_dedup.BASES):
        h = exact_dedup.Polynomial(modulus, base)
        whole = 0
        for x in data[:500].tolist():
            whole = (whole * base + x + 1) % modulus
        assert h.of(data[:500]) == whole
        for cut in (0, 1, 65536, 70_000, 299_999):
            assert h.combine(h.of(data[:cut]), h.of(data[cut:]), len(data) - cut) == h.of(data)


@pytest.mark.parametrize("moduli,group", [(exact_dedup.MODULI, 256), ((2, 3), 256), ((2, 3), 4)])
def test_exact(odd, empty, moduli, group):
    import re

    rows = pairs(odd.select("doc_id", "text"))
    key = {(i, t): re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    members = collections.defaultdict(list)
    for r in rows:
        members[key[r]].append(r[0])
    expected = collections.Counter()
    for r in rows:
        own = members[key[r]]
        keep = min((i for i in own if i is not None), default=None)
        expected[(r[0], keep, len(own), keep is None or r[0] == keep, hashlib.sha256(key[r].encode()).hexdigest())] += 1
    got = collections.Counter(pairs(exact_dedup.exact_duplicates(odd, moduli=moduli, group=group)))
    assert got == expected
    assert exact_dedup.exact_duplicates(empty).collect() == []


# 9


def test_mixing(spark):
    done = queries.op9_mixing(spark, "/root/testdata/sf0.01").cache()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes, source = {}, {}
    for r in truth.collect():
        sizes[r.doc_id], source[r.doc_id] = len(plain.WORD.findall(r.text or "")), r.source
    totals = collections.Counter()
    for i, n in sizes.items():
        totals[source[i]] += n
    target, taken = plain.mix_targets(totals), collections.Counter()
    rows = done.collect()
    assert len(rows) == len(sizes)
    for r in rows:
        assert (r.size, r.source_size) == (sizes[r.doc_id], totals[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        wanted = r.target / r.source_size
        assert not r.size or math.floor(wanted + 1e-9) <= r.taken / r.size <= math.ceil(wanted - 1e-9)
        taken[source[r.doc_id]] += r.taken
    for s in totals:
        assert abs(taken[s] - target[s]) <= max(n for i, n in sizes.items() if source[i] == s)
    again = queries.op9_mixing(spark, "/root/testdata/sf0.01")
    assert sorted(pairs(again)) == sorted(map(tuple, rows))


def test_mixing_levels_and_chances(spark):
    rows = [(k, "s", 0.3, 1 + k % 7) for k in range(3000)] + [(5000, None, 0.5, 4)]
    given = spark.createDataFrame(rows, "row long, source string, p double, size long").cache()
    picked = collections.Counter()
    for seed in range(3):
        done = dict(pairs(mixing.rounded(given, seed=seed, block=8)))
        assert len(done) == len(rows) and set(done.values()) <= {0, 1}
        words = sum(n * done[k] for k, s, _, n in rows if s)
        assert abs(words - sum(0.3 * n for _, s, _, n in rows if s)) <= 7
        picked.update(k for k, c in done.items() if c)
    assert abs(sum(picked.values()) / 9000 - 0.3) < 0.02


@pytest.mark.parametrize("same", [None, 7])
def test_mixing_rows_alike(spark, same):
    """Rows that lack an id or share one are drawn one by one, also when all else is equal."""
    alike = spark.range(3000).select(F.lit(same).cast("long").alias("doc_id"), F.lit("a b c d e f g").alias("text"), F.lit("s").alias("source"))
    differ = spark.range(900).select(
        F.lit(same).cast("long").alias("doc_id"), F.concat(F.lit("x y z "), F.col("id")).alias("text"), F.lit("t").alias("source")
    )
    rows = mixing.mix_sources(alike.union(differ).repartition(5), weights=(11.0, 13.6), share=1.0).collect()
    assert len(rows) == 3900
    for source, each in (("s", 7), ("t", 4)):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= each
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


def test_mixing_odd(odd, empty, spark):
    done = mixing.mix_sources(odd)
    rows = done.collect()
    assert len(rows) == odd.count()
    assert {r.taken for r in rows if not r.size} == {0}
    assert mixing.mix_sources(empty).collect() == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix_sources(wordless).collect()} == {(0.0, 0)}


def test_sources_in_code_point_order(spark):
    names = ["b", "a", None, "Z", "é", "\U0001f600", "\uffee", ""]
    given = spark.createDataFrame([(s, 1, 1) for s in names], "source string, source_size long, n_docs long")
    places = {r.source: r.place for r in mixing.ranked(given).collect()}
    assert [places[s] for s in sorted((s for s in names if s is not None))] == list(range(7)) and places[None] == 7


# 10


def plain_rule(host, path):
    fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return plain.lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


URLS = [
    (1, "http://A.example.NET/x"), (2, "https://example.net/en/1"), (3, "http://example.com/de/"), (4, "http://example.com/de"),
    (5, "http://badnet/x"), (6, "http://net"), (7, "http://net/"), (8, None), (9, "no scheme"), (10, "http://a.org/fr/x?y#z"),
    (11, "HTTP://www.Example.com/a?utm_source=1#t"), (12, "https://example.com/a"), (13, "x://y.net://z/"), (14, "http://a.net?x/en/"),
    (15, "http://example.com/a\nb"), (12, "https://example.com/a"), (None, "http://q.net/"),
]


def test_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    given = spark.createDataFrame([(i, u, None, "x") for i, u in URLS], "page_id long, url string, html string, host string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for df in (given, pages):
        got = collections.Counter((r.page_id, r.host, r.path, r.rule) for r in url_filter.judge_urls(df, rules).collect())
        assert got == collections.Counter((i, *plain_parts(u), plain_rule(*plain_parts(u))[0]) for i, u in pairs(df.select("page_id", "url")))
        assert all(r.verdict == dict(url_filter.RULES)[r.rule] for r in url_filter.judge_urls(df, rules).collect() if r.rule)
    assert url_filter.judge_urls(given.where("false"), rules).collect() == []


class PlainLinks(html.parser.HTMLParser):
    """Canonical and refresh targets before the first tag that does not belong in a head."""

    HEAD = {"html", "head", "title", "base", "link", "meta", "style", "script", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = True, []

    def handle_starttag(self, tag, attrs):
        self.open = self.open and tag in self.HEAD
        attrs = {k: v or "" for k, v in attrs}
        if self.open and tag == "link" and "canonical" in attrs.get("rel", "").lower().split():
            self.found.append(attrs.get("href", "").strip())
        if self.open and tag == "meta" and attrs.get("http-equiv", "").strip().lower() == "refresh":
            target = re.search(r"(?is)\burl\s*=\s*(?:\"([^\"]*)|'([^']*)|(.*))", attrs.get("content", ""))
            self.found += [next(x for x in target.groups() if x is not None).strip()] if target else []

    def handle_endtag(self, tag):
        self.open = self.open and tag != "head"


def plain_key(url):
    parts = urllib.parse.urlsplit(url)
    port = {"http": ":80", "https": ":443"}.get(parts.scheme.lower(), "-")
    host = parts.netloc.lower().removesuffix(port)
    return parts.scheme.lower(), host, parts.path or "/", parts.query


def plain_verdicts(rows):
    """Verdicts by flooding each component from its URLs."""
    rule = dict(url_filter.RULES)
    near, said = collections.defaultdict(set), collections.defaultdict(set)
    for _, url, text in rows:
        if url is None or "://" not in url:
            continue
        parser = PlainLinks()
        parser.feed(text or "")
        for link in [url, *(urllib.parse.urljoin(url, x) for x in parser.found if x)]:
            near[plain_key(url)].add(plain_key(link))
            near[plain_key(link)].add(plain_key(url))
            said[plain_key(link)].add(plain_rule(*plain_parts(link))[1])

    def verdict(url):
        own = plain_rule(*plain_parts(url))[1]
        if own or url is None or "://" not in url:
            return own or "allow"
        seen, todo = set(), [plain_key(url)]
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += near[node]
        told = set().union(*(said[n] for n in seen))
        return "allow" if "allow" in told or "block" not in told else "block"

    return {i: verdict(url) for i, url, _ in rows}


LINKED = [
    (1, "http://a.com/", "<meta http-equiv='refresh' content=\"0; url='http://x.net/1'\">"),  # a quoted target
    (2, "http://b.com/", '<link rel="canonical" href="http://q.com/"><link href="http://x.net/2" rel="alternate canonical">'),  # the second one
    (3, "http://c.com/d/e/f", '<head><link rel="canonical" href="../../x/./y"></head>'),
    (4, "http://c.com/x/y", '<meta content="5;URL=http://x.net/4" http-equiv="Refresh">'),
    (5, "http://d.com/", '<link rel="canonical" href="http://e.com/p?a=1&amp;b=2">'),
    (6, "http://e.com/p?a=1&b=2", '<link rel=canonical href=http://x.net/6>'),
    (7, "http://f.com/", '<!-- <link rel="canonical" href="http://x.net/7"> --><title>t</title>'),
    (8, "http://g.com/", '<html><body><pre><link rel="canonical" href="http://x.net/8"></pre></body>'),
    (9, "http://h.com/", '<p>x</p><link rel="canonical" href="http://x.net/9">'),
    (10, "http://i.com/?ref=1", '<link rel="canonical" href="http://x.net/10">'),
    (11, "http://i.com/", None),  # no alias of page 10
    (12, "http://www.i.com/?ref=1", ""),  # nor this one
    (13, "http://j.com/a?b", '<link rel="canonical" href="?c&#x3d;1"><meta http-equiv="refresh" content="0;url=&quot;/k&quot;">'),
    (14, "http://j.com/a?c=1", '<link rel="canonical" href="http://x.net/14">'),
    (15, "http://j.com/k", '<script>"<link rel=canonical href=http://org/fr/>"</script>'),
    (16, "http://k.com/", '<link rel="canonical" href=""><meta http-equiv="refresh" content="30">'),
    (17, "http://l.com/../z/..", '<link rel="canonical" href="m/../../../n/">'),
    (18, "http://l.com/n/", '<LINK REL=CANONICAL HREF="HTTP://X.NET/18#t">'),
    (19, "http://m.com/", "<!-- never closed <link rel=canonical href=http://x.net/19>"),
]


def test_url_verdicts_against_plain(spark, sf_dir):
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    given = spark.createDataFrame(LINKED, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(given, rules).collect()}
    wanted = plain_verdicts(LINKED)
    blocked = {1, 2, 3, 4, 5, 6, 10, 13, 14, 15, 17, 18}
    assert {i for i, v in wanted.items() if v == "block"} == blocked
    assert got == wanted
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pairs(pages.select("page_id", "url", "html"))
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()} == plain_verdicts(rows)


def test_url_aliases(spark):
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    canonical = '<html><head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://a.com/1", '<link rel=canonical href="http://b.net/1">'),  # an alias of a blocked page
        (2, "https://b.net/1#top", None),
        (3, "http://c.com/x/1", "<meta http-equiv=\"refresh\" content=\"0; url=2\">"),  # relative
        (4, "http://c.com/x/2", canonical.replace("rel=", "rel =").format("https://d.org/fr/")),  # an explicit allow
        (5, "http://e.com/", canonical.format("//f.net/")),
        (6, "HTTP://E.com:80/#x", None),  # blocked: the same URL as page 5
        (7, "http://g.com/", None),
        (8, "https://d.org/fr/", canonical.format("http://h.net/")),
        (9, "http://c.com/x/1?utm_medium=2&ref=z", ""),
        (10, None, canonical.format("http://b.net/1")),
        (11, "http://www.e.com/?utm_source=1", None),  # no edge states that it is page 5
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(given, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    loose = {r.page_id: r.verdict for r in url_filter.judge_urls(given, rules, loose=True).collect()}
    assert loose == got | {11: "block"}
    moved = spark.createDataFrame([("http://g.com/", "http://f.net/"), (None, "http://x")], "source string, target string")
    again = {r.page_id: r.verdict for r in url_filter.judge_urls(given, rules, redirects=moved).collect()}
    assert again[7] == "block"


# The pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = docs
    for name in ("language_id", "line_dedup", "minhash", "mixing"):
        before = {r.doc_id: r for r in step.collect()}
        step = stages[name](spark, step, sf_dir).cache()
        rows = step.collect()
        assert step.columns == docs.columns
        if name == "language_id":
            assert all(before[r.doc_id] == r for r in rows) and len(rows) > 0.99 * len(before)
        elif name == "line_dedup":
            expected = plain.line_dedup([(i, r.text) for i, r in before.items()])
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows} == {i: x[2] for i, x in expected.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "minhash":
            groups = plain.near_duplicates([(i, r.text) for i, r in before.items()])
            assert {r.doc_id for r in rows} == {i for i, (_, c) in groups.items() if c == i}
        else:
            assert max(collections.Counter(r.doc_id for r in rows).values()) <= 3
            assert all(before[r.doc_id] == r for r in rows)
    ids = stages["byte_bpe"](spark, step, sf_dir).collect()
    texts = {r.doc_id: r.text for r in step.collect()}
    assert len(ids) == step.count()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ENCODING.encode_ordinary(texts[r.doc_id]) for r in ids)
    assert base64.b64encode(b"") == b"" and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_rows_by_their_own_decision(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    texts = [(1, a), (2, a + " end"), (2, b), (2, b), (None, a), (None, c), (None, None), (None, None), (3, None), (3, b), (3, "")]
    rows = [(i, t, "en", "s", n) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.n_chars for r in got) == [0, 2, 3, 4, 5, 6, 7, 8, 10]  # not 1 (like a) and 9 (b)


def test_pipeline_odd(spark, odd):
    step, counts = odd, collections.Counter
    for name, stage in corpus_pipeline.STAGES:
        before = step.collect()
        step = stage(spark, step, "").cache()
        rows = step.collect()
        if name == "language_id":
            lettered = [r.doc_id for r in before if any(x.isalpha() for x in r.text or "")]
            assert not counts(r.doc_id for r in rows) - counts(lettered) and any(r.doc_id is None for r in rows)
        elif name in ("line_dedup", "byte_bpe"):
            assert counts(r.doc_id for r in rows) == counts(r.doc_id for r in before)
        elif name == "minhash":
            given = spark.createDataFrame(before, odd.select(*corpus_pipeline.COLUMNS).schema)
            kept = [r for r in minhash.near_duplicates(given).collect() if r.kept]
            assert counts(r.doc_id for r in rows) == counts(r.doc_id for r in kept)
            assert counts(r for r in before if r.doc_id is None) == counts(r for r in rows if r.doc_id is None)
        else:
            assert rows and set(rows) <= set(before)


def test_cells_meet_every_pair_once(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(90)], "cell long, id long")

    def pairs_of(table, ends, _cells):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        crossing = table.column("part_a").to_numpy() != table.column("part_b").to_numpy()
        found = [(int(min(ids[a], ids[b])), int(max(ids[a], ids[b])))
                 for i, j in cells.pair_steps(ends, crossing, table.column("side").to_numpy()) for a, b in zip(i, j)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    for block in (1000, 7):
        met = pairs(cells.in_cells(cells.split_cells(rows, block), pairs_of, "a long, b long"))
        assert sorted(met) == sorted((a, b) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3)
