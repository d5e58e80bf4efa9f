"""Run detection, the dataset manifest and the quality classifier against brute force and held-out rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import classifier, manifest, queries, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, level string, path string, part string"


def rows_to_docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def brute_runs(s):
    n, out = len(s), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(s[i:j + q - d] == s[i + d:j + q] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        n, k = rng.randrange(1, 90), rng.choice([1, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            s = ([rng.randrange(k) for _ in range(rng.randrange(1, 9))] * 90)[:n]
            for _ in range(rng.randrange(4)):
                s[rng.randrange(n)] = rng.randrange(k)
        assert runs.find_runs(np.array(s, dtype=np.int64)) == brute_runs(s)


def test_grammar_extensions_equal_plain_comparison():
    rng = random.Random(9)
    for _ in range(60):
        s = [rng.randrange(2) for _ in range(rng.randrange(2, 12))] * rng.randrange(1, 12)
        s[rng.randrange(len(s))] = 2
        grammar = runs.Grammar(np.array(s))
        for _ in range(60):
            x, y = sorted(rng.sample(range(len(s)), 2))
            ahead = next((k for k in range(len(s) - y) if s[x + k] != s[y + k]), len(s) - y)
            back = next((k for k in range(x + 1) if s[x - k] != s[y - k]), x + 1)
            assert (grammar.forward(x, y), grammar.backward(x, y)) == (ahead, back)


def test_candidates_do_not_depend_on_the_block():
    s = np.random.default_rng(2).integers(0, 3, 400)
    a, b = runs.candidates(s), runs.candidates(s, block=50)
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_runs_of_documents(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    plain = "a b " * 9 + "c d e\tf g\n"
    texts = [(None, None), (1000, None), (1001, " \n"), (1002, ""), (1003, "one"), (None, plain), (1005, plain),
             (1005, plain), (1006, "\U0001f600 " * 7), (1007, "w" * 200000)]
    texts += [(i, " ".join(f"w{k % 40}" for k in range(100 + i))) for i in ids]
    got = runs.detect_runs(rows_to_docs(spark, [(i, t, "en", "s", 1) for i, t in texts]), runs.planted).collect()
    want = []
    for i, t in texts:
        words = (t or "").encode().split()
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        found = brute_runs(words)
        best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if found else (None, None, None)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        rest = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r["n_runs"] > 0 for r in got) >= 5


def test_empty_tables(spark):
    none = rows_to_docs(spark, [(1, "a", "en", "s", 1)]).where("doc_id = 2")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert runs.detect_runs(none).count() == 0
    assert manifest.manifest(none, F.lit(True)).count() == 0
    assert classifier.score(none, classifier.fit(none, labels)).count() == 0


@pytest.mark.parametrize("part", [2, 8, 4096])
def test_manifest_equals_sql(spark, tmp_path, part):
    rng = random.Random(part)
    rows = [(i, f"text {i}", rng.choice(["en", "de", "é", "Z", "en"]), "s", i) for i in range(150)]
    rows += [(900, None, None, None, None), (901, "", None, "s", 3), (902, "solo", "solo", "s", 1),
             (5, "again", "en", "s", 5), (7, "same", "en", "s", 7), (7, "same", "en", "s", 7), (None, "x", "en", "s", 2),
             (None, "x", "en", "s", 2), (904, "long " * 40000, "de", "s", None)]
    docs = rows_to_docs(spark, rows)
    docs.write.parquet(str(tmp_path / "d"))
    got = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, part)
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
        found = db.sql(manifest.oracle(8))
        assert found.columns == got.columns
        want = sorted(found.fetchall(), key=repr)
    mine = sorted(map(tuple, got.collect()), key=repr)
    assert len(mine) == len(want)
    assert [(a, b) for a, b in zip(mine, want) if a != b] == []


def test_multiproof_is_minimal_and_whole():
    rng = random.Random(3)
    for count in (1, 2, 3, 5, 8, 13, 64, 77):
        leaves = {i: hashlib.sha256(str(i).encode()).hexdigest() for i in range(count)}
        level, every, root_level = list(leaves.values()), {}, manifest.height(count)
        for k in range(root_level + 1):
            every |= {(k, i): d for i, d in enumerate(level)}
            level = manifest.parents(level) if k < root_level else level
        own = {i: leaves[i] for i in rng.sample(range(count), rng.randrange(1, count + 1))}
        need = manifest.missing_nodes(own, count)
        nodes = manifest.derived(own, count, {c: every[c] for c in need})
        assert nodes[root_level, 0] == every[root_level, 0]
        assert all(manifest.fold(d, manifest.proof_path(nodes, i, count)) == level[0] for i, d in own.items())
        below = {(0, i) for i in own} | {(k, i >> k) for i in own for k in range(root_level + 1)}
        assert not below & set(need) and len(set(need)) == len(need)


def test_classifier_learns_and_scores_whole_texts(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"] + ([] if good else ["BUY!!", "NOW!!", "$$$"]))
                 for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(good), 0))
    rows += [(700, None, None, None, None), (None, "", None, None, None), (701, rows[0][1], "de", "t", 9),
             (702, "alpha beta " * 30000, None, None, None)]
    labels += [(None, 1, 0), (3, None, 0), (4, 7, 0)]
    docs = rows_to_docs(spark, rows)
    model = classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 200)
    got = {r["doc_id"]: r for r in classifier.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.98 * len(held)
    assert got[0]["score"] == got[701]["score"] and got[700]["score"] == got[None]["score"]
    assert got[702]["predicted"] == 1 and len(got) == len(rows)


def test_sparse_dot_product_equals_counting():
    text = "One two THREE 4 4 4!! one two"
    index, owner = classifier.grams([text.encode(), b"", b"x"], 64)
    words = text.encode().split()
    model = classifier.Model(np.arange(64) / 64, 0.25)
    mine = index[owner == 0]
    assert len(mine) == 5 * len(words) - 4 and (owner == 1).sum() == 0 and (owner == 2).sum() == 2
    want = 1 / (1 + np.exp(-(0.25 + classifier.SCALE * sum(model.weights[b] for b in mine) / len(mine))))
    assert abs(model.scores([text.encode(), b"", b"x"])[0] - want) < 1e-9


def test_queries_are_registered():
    assert {"op11_period_runs", "op12_merkle_manifest", "op13_quality_classifier"} <= queries.all_queries().keys()
