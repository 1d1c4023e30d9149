"""The whole pipeline on a small table, stage by stage, and on odd tables."""

import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from tokenloom.llm import bpe, packing, queries
from tokenloom.llm.common import forget, salted_join, stored


def test_registered():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in found if q.startswith("op")}
    assert "pipeline" in found
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        found = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert before is None or found <= before
        before, docs = found, stored(out, "stage")
    out = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in out} == before
    # The sequences hold the ids of every text that stayed, whole and in order.
    lib = tokenizers.Tokenizer.from_str(queries.tokenizer("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, room = {}, {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]] += r["ids"]
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert all(got[k] == [*lib.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items())
    assert max(room.values()) <= 2048


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, columns with clashing names, then no rows at all."""
    pytest.importorskip("public_tokenizers")
    good = " ".join("".join(w) + "en" for w in itertools.product("bdfgk", "aeiou", "lmnr"))
    rows = [(1, good, "en", "a", 5, "x"), (1, good, "en", "a", 5, "x"), (2, None, None, None, None, None), (None, None, None, None, None, None), (None, good + " more", "en", "a", 1, "x"), (3, "", "en", "a", 0, "x"), (4, good.upper(), "en", "b", 1, "x"), (5, "x " * 30_000, "en", "b", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    for name, some in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            docs = stored(run(spark, docs, folder), "stage")
            assert docs.columns == [f.split()[0] for f in schema.split(", ")], stage
        kept = docs.collect()
        out = corpus_pipeline.run(spark, folder).collect()
        assert len({(r["doc_id"]) for r in out}) == len({r["doc_id"] for r in kept})
        assert (len(kept) > 0) == bool(some)
        # Exact copies and those that differ in case of letters alone are one document.
        assert sum(r["doc_id"] in (1, 4) for r in kept) <= 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_padding_is_little(spark):
    pytest.importorskip("public_tokenizers")
    out = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.tokenizer("word_bpe_49k.json"))
    sizes = np.array([r["n"] for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()])
    assert 1 - sizes.sum() / (2048 * len(sizes)) < 0.02


def test_forgotten_tables_are_gone(spark):
    one = stored(spark.range(3).toDF("k"), "gone")
    path = one.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    forget(one)
    assert not os.path.exists(path)
    outside = spark.createDataFrame([(1,)], "k long")
    forget(outside)


def test_tables_of_the_driver_need_no_python_workers(spark):
    """Slots and hot keys are local tables: lists of rows would start Python workers beside those of the kernels."""
    many = spark.createDataFrame(pa.table({"k": [1] * 300 + [None, 2], "v": list(range(302))}))
    few = spark.createDataFrame(pa.table({"k": [1, 2, None], "w": [b"a", b"b", b"c"]}))
    joined = salted_join(many, few, ["k"], seed="v")
    assert joined.columns == ["k", "v", "w"]
    assert sorted((r["k"], r["v"], bytes(r["w"])) for r in joined.collect()) == [(1, v, b"a") for v in range(300)] + [(2, 301, b"b")]
    rows = spark.createDataFrame(pa.table({"doc_id": [1, 2, 3], "start": [0, 0, 0], "length": [5, 5, 2048], "ids_crc32": [7, 8, 9], "doc_tokens": [5, 5, 2048]}))
    packed = packing.pack(rows)
    assert sorted((r["doc_id"], r["offset"]) for r in packed.collect()) == [(1, 0), (2, 5), (3, 0)]
    assert packing.pack(rows.limit(0)).count() == 0
    for df in (joined, packed):
        assert "RDD" not in df._jdf.queryExecution().toString()


def test_packing_gives_memory_back_part_by_part(monkeypatch):
    """Lean parts are small, what they free is given back after each, and the pieces are the same."""
    pytest.importorskip("public_tokenizers")
    model = bpe.Bpe(queries.tokenizer("word_bpe_49k.json"), 1000)
    texts = [None, "", *(f"Some words, number {k} and {k * 7919}.\n" * 2000 for k in range(40))]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "_text"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    given = []
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    plain = list(packing.in_parts([batch], model, 2048, 1, True, names))
    assert not given
    lean = list(packing.in_parts([batch], model, 2048, 1, True, names, lean=True))
    assert len(given) == len(lean) >= 3 * len(plain)
    assert pa.Table.from_batches(lean).combine_chunks() == pa.Table.from_batches(plain).combine_chunks()
