"""Separator scan against a plain loop over the stream."""

from __future__ import annotations

import numpy as np
import pytest

from logtide.llm import tokencount


def expected(files, separator):
    out, run = [], 0
    for _, ids in sorted(files.items()):
        for x in ids:
            if x == separator:
                out.append(run)
                run = 0
            else:
                run += 1
    return out + ([run] if run else [])


@pytest.mark.parametrize("block", [2, 6, 64, 4096])
def test_scan_matches_loop(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(tokencount, "RUN", 3)
    rng = np.random.default_rng(block)
    files = {f"t{i}.bin": rng.choice([9, 1, 2, 3], size=n, p=[0.15, 0.3, 0.3, 0.25])
             for i, n in enumerate([0, 50, 1, 200, 7])}
    files["t5.bin"] = np.full(40, 3)
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    rows = tokencount.scan(spark, str(tmp_path), 9, 2, block).orderBy("doc").collect()
    assert [r["n_tokens"] for r in rows] == expected(files, 9)
    assert [r["doc"] for r in rows] == list(range(len(rows)))


def test_empty_store_and_partial_id(spark, tmp_path):
    assert tokencount.scan(spark, str(tmp_path), 9).count() == 0
    (tmp_path / "a.bin").write_bytes(b"\x01\x00\x02")
    with pytest.raises(ValueError):
        tokencount.scan(spark, str(tmp_path), 9)


def test_written_store_is_counted(spark, tmp_path):
    docs = [(i, np.arange(1, 1 + i % 5, dtype="<u4").tobytes()) for i in range(40)] + [(99, None)]
    folder = str(tmp_path / "store")
    placed = tokencount.write_store(spark.createDataFrame(docs, "doc_id long, ids binary").repartition(3), folder, 60000)
    found = {r["doc_id"]: (r["file"], r["nth"]) for r in placed.collect()}
    counted = {(r["file"], r["nth"]): r["n_tokens"] for r in tokencount.scan(spark, folder, 60000).collect()}
    assert {i: counted[at] for i, at in found.items()} == {i: len(b or b"") // 4 for i, b in docs}
