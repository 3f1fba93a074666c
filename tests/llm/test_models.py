"""Decontamination and LM scoring: brute force, recall and held-out accuracy; the pipeline."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import decontaminate, lm_score
from tallyloom.llm.common import split_words

from .conftest import SCHEMA, prose

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


# --- 8: decontamination -------------------------------------------------------------


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randint(0, 5) for _ in range(rng.randint(1, 30))]
        b = [rng.randint(-1, 5) for _ in range(rng.randint(0, 40))]
        assert decontaminate.lcs_length(decontaminate.lcs_mask_tables(a), len(a), b) == brute_lcs(a, b)


def paraphrase(text, seed):
    rng = random.Random(seed)
    return " ".join("other" if rng.random() < 0.15 else w for w in text.split())


def test_leaks(spark, frame):
    items = [(i, prose(1000 + i, 35)) for i in range(30)] + [(30, None), (31, "")]
    docs = [(i, prose(i, 500), "s") for i in range(60)]
    leaks = {}
    for i in range(12):
        leaks[100 + i] = i
        docs.append((100 + i, prose(200 + i, 150) + " " + items[i][1].upper() + "! " + prose(300 + i, 150), "s"))
    for i in range(12, 20):
        leaks[100 + i] = i
        docs.append((100 + i, prose(200 + i, 90) + " " + paraphrase(items[i][1], i) + " " + prose(300 + i, 20), "s"))
    docs += [(None, items[3][1], "s"), (900, None, "s"), (901, "", "s"), (902, "  ", "s"), (903, prose(77, 20000) + " " + items[25][1], "s")]
    leaks[903] = 25
    leaks[None] = 3
    benchmark = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(frame(docs), benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == set(leaks.items())
    kept = decontaminate.drop_leaks(frame(docs), benchmark)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, *_ in docs if d not in leaks)
    assert kept.columns == frame(docs).columns and decontaminate.drop_leaks(frame(docs), benchmark.limit(0)).count() == len(docs)
    assert decontaminate.find_leaks(spark.createDataFrame([], SCHEMA), benchmark).collect() == []
    assert decontaminate.find_leaks(frame(docs), benchmark.limit(0)).collect() == []


def test_the_stretch_with_the_answer_counts():
    """A stretch of LCS 0.65 without the answer, before or after one of 0.625 with it."""
    words = [f"w{i}" for i in range(40)]
    items = decontaminate.Items.of([(9, " ".join(words))])
    limits = {"window": 40, "least_cosine": 0.4, "sure": 0.8, "likely": 0.6, "answer": 8}
    searcher = decontaminate.Searcher(items, np.ones(40), np.eye(40), **limits)
    head, tail, gap = words[:26], words[15:], ["other"] * 400
    for text in (head + gap + tail, tail + gap + head):
        [(item, _, lcs, answered, *_)] = searcher.matches(" ".join(text))
        assert (item, lcs, answered) == (9, 0.625, 1)
    assert searcher.matches(" ".join(head + gap + head)) == []


def test_long_items_leak(spark, frame):
    """Verbatim and paraphrased copies of items far longer than a window, found whole."""
    sizes = [50, 61, 150, 400, 1000, 2500]
    items = [(i, prose(5000 + i, n)) for i, n in enumerate(sizes * 2)]
    docs = [(i, prose(6000 + i, 500), "s") for i in range(60)]
    for i, text in items:
        copy = text.upper() if i < len(sizes) else paraphrase(text, i)
        docs.append((100 + i, prose(7000 + i, 333) + " " + copy + " " + prose(8000 + i, 777), "s"))
    got = decontaminate.find_leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(100 + i, i) for i, _ in items}
    assert all(r["lcs"] == 1 for r in got if r["item_id"] < len(sizes))


def test_randomised_svd_finds_the_space(spark):
    texts = [" ".join(random.Random(i).choices(["a", "b", "c", "d", "e", "f"], k=40)) for i in range(60)]
    index = {w: i for i, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f"])}
    weights = np.array([1.0, 2, 1, 0.5, 3, 1])
    basis, values = decontaminate.randomised_svd(spark.createDataFrame([(t,) for t in texts], "text string"), index, weights, rank=6, window=40)
    rows = np.array([[t.split().count(w) for w in "abcdef"] for t in texts]) * weights
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert values == pytest.approx(np.linalg.svd(rows, compute_uv=False), rel=1e-4)
    assert basis.T @ basis == pytest.approx(np.eye(6), abs=1e-4)


@needs_data
def test_recall_against_brute_force(spark):
    """Every item that a document holds by most of its 8-word shingles is found: recall 0.9 at least (1.0 here)."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    shingles, sizes = {}, {}
    for r in benchmark.collect():
        words = decontaminate.plain_words(r["text"])
        sizes[r["item_id"]] = len(words) - 7
        for i in range(len(words) - 7):
            shingles.setdefault(tuple(words[i : i + 8]), set()).add(r["item_id"])
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = decontaminate.plain_words(r["text"] or "")
        hits = Counter(i for k in range(len(words) - 7) for i in shingles.get(tuple(words[k : k + 8]), ()))
        want |= {(r["doc_id"], i) for i, n in hits.items() if n >= 0.5 * sizes[i]}
    assert len(want) > 10 and len(got & want) >= 0.9 * len(want)
    assert len(got - want) <= 0.05 * len(got)


@needs_data
def test_candidates_against_exhaustive_lcs(spark):
    """Every pair of document and item by the longest common subsequence of all stretches: 0.9 or more are found."""
    folder = "/root/testdata/sf0.001"
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    items = decontaminate.Items.of([(r["item_id"], r["text"]) for r in benchmark.collect()])
    tables = [(lcs(w), len(w), lcs(w[-8:]), len(w[-8:])) for w in items.words]
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = decontaminate.numbers(r["text"] or "", items.index)
        some = np.flatnonzero(words >= 0)
        for i, (table, size, tail, n) in enumerate(tables):
            reach = 2 * max(40, size)
            mine = some[np.isin(words[some], list(table))]
            if len(mine) < 0.6 * size:
                continue
            for at in range(0, max(1, len(words) - reach // 2), reach // 2):
                stretch = words[at : at + reach].tolist()
                shared = decontaminate.lcs_length(table, size, stretch) / size
                if shared >= 0.8 or shared >= 0.6 and decontaminate.lcs_length(tail, n, stretch) / n >= 0.6:
                    want.add((r["doc_id"], items.ids[i]))
    assert len(want) > 2 and len(got & want) >= 0.9 * len(want)


lcs = decontaminate.lcs_mask_tables


def test_many_items_in_blocks(spark, frame, monkeypatch):
    """Blocks of few cosines and few tables give the same leaks."""
    items = [(i, prose(1000 + i, 35)) for i in range(40)]
    docs = [(i, prose(i, 200) + " " + items[i][1] + " " + prose(i, 50), "s") for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [t for _, t, _ in docs]
    search = decontaminate.fitted_search(frame(docs), benchmark, "doc_id", "text")
    want = [search().matches(t) for t in texts]
    monkeypatch.setattr(decontaminate, "COSINES", 100)
    monkeypatch.setattr(decontaminate, "HELD_TABLES", 1)
    assert [search().matches(t) for t in texts] == want and all(want)


def test_the_space_is_fitted_on_all_documents(spark):
    """The space of 10,400 documents, some without id, is that of all their passages, not of the first 10,000 by a hash."""
    rng = random.Random(4)
    words, others = ["ab", "cd", "ef", "gh", "ij"], [f"w{i}" for i in range(100)]
    texts = [" ".join(rng.choices(words + others, k=12)) for _ in range(10_400)]
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    searcher = decontaminate.fitted_search(docs, benchmark, "doc_id", "text")()
    rows = np.array([[t.split().count(w) for w in words] for t in texts], float)
    weights = np.square(np.log((1 + len(texts)) / (1 + (rows > 0).sum(axis=0))))
    rows *= weights
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    # whatever the signs and the turns of the basis: W V S^-2 V^T W
    want = np.diag(weights) @ np.linalg.inv(rows.T @ rows) @ np.diag(weights)
    got = searcher.projection.astype(float)
    assert got @ got.T == pytest.approx(want, abs=2e-3 * want.max())


@pytest.fixture(scope="module")
def rare_leaks(spark):
    """10,100 documents of which those with the largest id hashes, and two without id, alone have the words of items 20 to 24."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"a{i}" for i in range(400)]
    items = [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(20)] + [(i, " ".join(f"b{i}x{k}" for k in range(30))) for i in range(20, 25)]
    ids = [r["id"] for r in spark.range(10_098).orderBy(F.xxhash64("id"), "id").collect()]
    leaks = {(ids[-3], 20), (ids[-2], 21), (ids[-1], 22), (None, 23), (None, 24)}
    docs = [(d, " ".join(rng.choices(words, k=30))) for d in ids[:-3]] + [(d, f"some words {items[i][1]} and more") for d, i in leaks]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), leaks


def test_words_of_a_few_documents_are_searched(rare_leaks):
    docs, benchmark, leaks = rare_leaks
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()} == leaks


# --- 10: LM scoring -----------------------------------------------------------------


def brute_scores(rows, targets, vocabulary, bits, strength):
    words = {d: split_words(t or "") for d, t in rows}
    every = Counter(w for ws in words.values() for w in ws)
    top = sorted(every, key=lambda w: (-every[w], w))[:vocabulary]
    index = {w: i + 2 for i, w in enumerate(top)}
    size = len(index) + 2

    def bucket(a, b):
        return ((a << 32 | b) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)

    def model(ids):
        uni, bi = Counter(), Counter()
        for d in ids:
            last = 1
            if words[d]:
                uni[1] += 1
            for w in words[d]:
                now = index.get(w, 0)
                uni[now] += 1
                bi[bucket(last, now)] += 1
                last = now
        total = sum(uni.values())

        def loss(d):
            out, last = 0.0, 1
            for w in words[d]:
                now = index.get(w, 0)
                p1 = (uni[now] + 1) / (total + size)
                joint = min(bi[bucket(last, now)], uni[last])
                out -= math.log((joint + strength * p1) / (uni[last] + strength))
                last = now
            return out / len(words[d])

        return loss

    wanted, background = model([d for d in words if d in targets]), model(list(words))
    return {d: (wanted(d), background(d)) if words[d] else (None, None) for d in words}


def test_scores_match_brute_force(spark, frame):
    rows = [(i, prose(i, 30 + i)) for i in range(30)] + [(50, None), (51, ""), (52, " \n"), (53, "A  b\tA b")]
    targets = spark.createDataFrame([(i,) for i in range(0, 30, 3)] + [(0,), (None,), (999,)], "doc_id long")
    want = brute_scores(rows, set(range(0, 30, 3)), 20, 8, 5.0)
    got = lm_score.score_documents(frame(rows).repartition(3), targets, vocabulary=20, bucket_bits=8, strength=5.0).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = want[r["doc_id"]]
        if a is None:
            assert r["score"] is None and r["n_tokens"] == 0
        else:
            assert (r["loss_target"], r["loss_background"]) == (pytest.approx(a, rel=1e-5), pytest.approx(b, rel=1e-5))
            assert r["score"] == pytest.approx(a - b, abs=1e-5)
    assert lm_score.score_documents(spark.createDataFrame([], SCHEMA), targets).collect() == []


def test_counts_are_exact_past_65536_words(spark, frame, monkeypatch):
    """Many rare words and bigrams, in several chunks and parts, against counts without buckets (64 bits lose nothing)."""
    monkeypatch.setattr(lm_score, "PART_BYTES", 100_000)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(300_000 if rng.random() < 0.5 else 50)}" for _ in range(600))) for i in range(400)] + [(900, None), (901, " ")]
    wanted = set(range(0, 400, 3))
    assert len({w for _, t in rows for w in (t or "").split()}) > 1 << 16
    want = brute_scores(rows, wanted, 1 << 30, 64, 200.0)
    got = lm_score.score_documents(frame(rows).repartition(3), spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = want[r["doc_id"]]
        assert a is None and r["score"] is None and r["n_tokens"] == 0 or (r["loss_target"], r["loss_background"]) == (pytest.approx(a, rel=1e-9), pytest.approx(b, rel=1e-9))


def test_no_targets_and_null_ids(spark, frame):
    rows = [(None, "a b c"), (1, "a b"), (1, "a b")]
    got = lm_score.score_documents(frame(rows), spark.createDataFrame([], "doc_id long")).collect()
    assert len(got) == 3 and all(r["score"] is not None for r in got)


def test_held_out_documents_of_the_target_score_lower(spark, frame):
    """Two sources with word habits of their own; half of one is the target, the other half is held out."""
    rng = random.Random(4)
    kinds = {0: ["alpha", "beta", "gamma", "delta"], 1: ["one", "two", "three", "four"]}
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) if rng.random() < 0.5 else rng.choice(["x", "y", "z"]) for _ in range(60))) for i in range(200)]
    targets = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(frame(rows), targets).collect()}
    held = [(got[i], i % 2) for i in range(100, 200)]
    pairs = [(a < b) for a, ka in held if ka == 0 for b, kb in held if kb == 1]
    assert sum(pairs) / len(pairs) > 0.95


# --- the pipeline and the queries -----------------------------------------------------


def test_pipeline_drops_leaks_of_a_few_documents(spark, rare_leaks, tmp_path):
    import corpus_pipeline

    docs, benchmark, leaks = rare_leaks
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    leaking = {d for d, _ in leaks}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i in range(10_098) if i not in leaking)


@needs_data
def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    from tallyloom.llm import line_dedup, quality_rules, simhash_dedup

    from .test_text_operators import brute_classes, brute_fingerprint, brute_lines

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(docs).collect()}
    first = corpus_pipeline.quality(spark, docs, folder)
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(d for d, k in judged.items() if k)
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    second = corpus_pipeline.lines(spark, first, folder)
    lined = {d: t for d, _, _, t in brute_lines(rows, 10)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in second.collect()} == {d: (t, len(t)) for d, t in lined.items()}
    third = corpus_pipeline.near_copies(spark, second, folder)
    classes = brute_classes({d: brute_fingerprint(t) for d, t in lined.items()}, 4)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(set(classes.values()))
    for stage in (first, second, third):
        assert stage.columns == docs.columns
    fourth = corpus_pipeline.decontamination(spark, third, folder)
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(third, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    want = sorted(set(classes.values()) - leaks)
    assert sorted(r["doc_id"] for r in fourth.collect()) == want
    final = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in final) == want
    import hashlib

    assert all(r["decoded_sha256"] == hashlib.sha256(lined[r["doc_id"]].encode()).hexdigest() for r in final)
    assert line_dedup is not None and simhash_dedup is not None


def test_pipeline_on_odd_rows(spark, frame, odd_rows, tmp_path):
    """Null and shared ids, repeated rows, clashing columns and an empty table, through all stages."""
    import corpus_pipeline

    items = [(i, prose(400 + i, 40)) for i in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = (prose(600 + i, 120) for i in range(3))
    rows = list(odd_rows) + [(70, a), (71, a), (71, b), (71, c), (None, c), (None, prose(700, 90)), (72, items[2][1] + " " + prose(3, 30)), (None, items[1][1])]
    for table, want in ((frame(rows), True), (frame([]), False)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.columns == before.columns, name
        kept = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect())
        final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(str(r["doc_id"]) for r in final) == [d for d, _ in kept]
        if want:
            texts = [t for _, t in kept]
            assert [d for d, t in kept if t == a] == ["70"] and [d for d, t in kept if t == b] == ["71"]
            assert [d for d, t in kept if t == c] == ["71"]  # the copy without an id goes
            assert prose(700, 90) in texts and not any(items[i][1] in t for i in (1, 2) for t in texts)
        else:
            assert kept == []


@needs_data
def test_queries_with_sql_agree(spark):
    import duckdb

    from tallyloom.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        ours = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in queries.queries()[name](spark, folder).collect())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        theirs = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())
        assert ours == theirs
    assert {n.split("_")[0] for n in queries.queries()} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
