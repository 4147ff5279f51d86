"""Each stage of the pipeline against brute force, on the smallest tables."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from evispark.llm import decontam, mixing

from .test_corpus import DATA, ODD, brute_groups, frame

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = P.language(spark, docs, DATA).cache()
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    single = P.near_duplicates(spark, kept, DATA).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in brute_groups([(r["doc_id"], r["text"]) for r in kept.collect()])})
    clean = P.decontaminate(spark, single, DATA).cache()
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    spaced = lambda ws: b" " + b" ".join(ws) + b" "
    dirty = {r["doc_id"] for r in single.collect() if any(spaced(t) in spaced(decontam.words_of(r["text"])) for t in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert not left & dirty and len(left) >= single.count() - len(dirty) - 1
    mixed = P.mix(spark, clean, DATA).cache()
    assert mixed.columns == docs.columns
    times, m = Counter(r["doc_id"] for r in mixed.collect()), {r["doc_id"]: r for r in mixing.mix(clean).collect()}
    assert all(abs(times[i] - r["taken"] / r["size"]) < 1 for i, r in m.items() if r["size"])
    tk = Tokenizer.from_file(P.tokenizer_path())
    got = P.token_ids(spark, mixed, DATA).collect()
    want = Counter((r["doc_id"], zlib.crc32(np.array(tk.encode(r["text"], add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in mixed.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through each stage, and empty tables."""
    odd = frame(spark, [*ODD, (20, "word " * 200000 + "end", None, "b"), (21, None, None, None), (None, "null id, a text of its own", "en", "a")])
    passed = {"language": lambda r: any(c.isalpha() for c in r["text"] or ""), "decontaminate": lambda r: True}
    for name, stage in P.STAGES:
        out = stage(spark, odd, DATA)
        if name != "token_ids":
            assert out.columns == odd.columns and out.dtypes == odd.dtypes
        rows = out.collect()
        if name in passed:
            key = lambda r: (r["doc_id"], r["text"], r["a.b"], r["score"])
            assert Counter(map(key, rows)) == Counter(map(key, filter(passed[name], odd.collect())))
        if name == "near_duplicates":
            assert len(rows) == len({f if c is None else c for _, f, c in brute_groups([(r["doc_id"], r["text"]) for r in odd.collect()])})
        if name == "mix":
            assert all(r["text"] for r in rows) and {r["source"] for r in rows} <= {"a", "b", "c", None}
        if name == "token_ids":
            assert len(rows) == odd.count()
        assert stage(spark, odd.limit(0), DATA).count() == 0
    assert P.language(spark, odd, DATA).where("doc_id = 20").first()["lang"] is not None
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.decontaminate(spark, odd, str(tmp_path)).count() == odd.count()


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    from evispark.llm import common

    class Context:
        master = "spark://somewhere:7077"
        getConf = spark.sparkContext.getConf

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            common.scratch_dir(Session())


def test_contract():
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "token_ids"] and P.ORACLE_SQL is None
