"""The engine's Spark plans: agreement of native and kernel plans, scans, trees, changes, streams, and the queries' oracles."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tokenloom import catalog
from tokenloom.functions import columns as c
from tokenloom.functions.text import pre_tokenizer, splitter, Text
from tokenloom.functions.tokenizer import Tokenizer
from tokenloom.functions.unicode import pattern
from tokenloom.operators import encode as e
from tokenloom.plans import tree
from tokenloom.sources import files as f
from tokenloom.streaming import decode as d
from tokenloom.streaming import refresh

TEXTS = ["the-final--countdown", "", "--a-", "a,b  c!d", " x １2 3é ", "Ünï\tcödé\r\n", "don't we'll", "日本 語", "a b c", "   ", "-"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").cache()


def column(texts, expression):
    return [r["p"] for r in texts.select("doc_id", expression.alias("p")).orderBy("doc_id").collect()]


@pytest.mark.parametrize("behavior", ["removed", "isolated", "contiguous", "mergedwithprevious", "mergedwithnext"])
def test_split_expressions_agree_with_kernels(texts, behavior):
    kernel = splitter(pattern("-"), behavior)
    assert column(texts, c.split(F.col("text"), "-", behavior)) == [[p.chars for p in kernel(Text(t, None))] for t in TEXTS]


@pytest.mark.parametrize(
    ("config", "expression"),
    [
        ({"type": "Whitespace"}, c.whitespace), ({"type": "WhitespaceSplit"}, c.whitespace_split), ({"type": "Punctuation"}, c.punctuation),
        ({"type": "Digits"}, c.digits), ({"type": "BertPreTokenizer"}, c.bert_words), ({"type": "FixedLength", "length": 3}, lambda t: c.fixed_length(t, 3)),
        ({"type": "CharDelimiterSplit", "delimiter": ","}, lambda t: c.delimiter(t, ",")), ({"type": "Metaspace"}, c.metaspace),
    ],
)
def test_pre_tokenizer_expressions_agree_with_kernels(texts, config, expression):
    kernel = pre_tokenizer(config)
    assert column(texts, expression(F.col("text"))) == [[p.chars for p in kernel(Text(t, None)) if p.chars] for t in TEXTS]


def test_glyphs_and_gpt2_words(texts):
    kernel = pre_tokenizer({"type": "ByteLevel", "add_prefix_space": False})
    words = F.transform(c.gpt2_words(F.col("text")), c.to_glyphs)
    assert column(texts, words) == [[p.chars for p in kernel(Text(t, None))] for t in TEXTS]
    assert column(texts, c.from_glyphs(c.to_glyphs(F.col("text")))) == TEXTS


def test_native_and_kernel_counts_agree(texts):
    config = catalog.word_level("Whitespace")
    assert e.native_words(config, False) is not None
    t = Tokenizer(config)
    found = {r["doc_id"]: r["n_tokens"] for r in e.count_tokens(texts, config).collect()}
    assert found == {k: t.count(x) for k, x in enumerate(TEXTS)}


def test_encode_decode_over_rows(texts):
    config = catalog.byte_level()
    coded = e.encode(texts, config)
    t = Tokenizer(config)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {k: t.encode(x).ids for k, x in enumerate(TEXTS)}
    assert {r["doc_id"]: r["decoded"] for r in e.decode(coded.select("doc_id", "ids"), config).collect()} == dict(enumerate(TEXTS))


def test_overflow_becomes_rows_and_batches_are_padded(texts):
    config = json.loads(catalog.word_level()) | {"truncation": {"max_length": 2, "stride": 0, "strategy": "LongestFirst", "direction": "Right"}}
    rows = e.encode(texts.where("doc_id in (3, 8)"), json.dumps(config), unit="char")
    assert sorted((r["doc_id"], r["part_no"], len(r["ids"])) for r in rows.collect()) == [(3, 0, 2), (8, 0, 2)]
    padded = e.pad_batches(e.encode(texts, catalog.word_level(), unit="char").withColumn("b", F.col("doc_id") % 2), "b", multiple=4)
    sizes = {(r["b"], len(r["ids"]), len(r["offsets"])) for r in padded.collect()}
    assert len(sizes) == 2
    assert all(n == m and n % 4 == 0 for _, n, m in sizes)


def test_roll_up_and_search(spark):
    files = spark.createDataFrame([("a.txt", 10, 5), ("sub/b.txt", 20, 7), ("sub\\deep/c.txt", 30, 9)], "rel_path string, length long, token_count int")
    found = {r["path"]: (r["token_count"], r["file_count"], r["file_size"]) for r in tree.roll_up(files).collect()}
    assert found[""] == (21, 3, 60)
    assert found["sub"] == (16, 2, 50)
    assert found["sub/deep"] == (9, 1, 30)
    hit = {r["path"] for r in tree.search(tree.roll_up(files), "DEEP").collect()}
    assert hit == {"", "sub", "sub/deep", "sub/deep/c.txt"}


def changes(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_changes_agree_with_a_rebuild(spark):
    one, path = "rel_path string, length long, token_count long", "rel_path string"
    full = "rel_path string, status string, length long, token_count long"
    files = changes(spark, [("a/x", 1, 1), ("a/y", 2, 2), ("b", 3, 3), ("c/d/e", 4, 4), ("k", 5, 5)], one)
    after = tree.apply_changes(
        files,
        changes(spark, [("B",)], path),
        changes(spark, [("a",)], path),
        changes(spark, [("a/z", "Counted", 7, 7), ("a/w", "SkippedBinary", 9, None)], full),
        changes(spark, [("c/d", "Counted", 8, 8), ("k", "Error", 0, None), ("a/x", "Counted", 1, 1), ("n/o", "Counted", 6, 6)], full),
    )
    assert {tuple(r) for r in after.collect()} == {("a/z", 7, 7), ("c/d", 8, 8), ("k", 5, 5), ("n/o", 6, 6)}


def test_path_rules(spark):
    rows = [("a//b",), ("",), ("/a",), ("C:x",), ("a/../b",), ("a\\b",), (None,)]
    found = spark.createDataFrame(rows, "p string").select(tree.valid_path(F.col("p")).alias("v")).collect()
    assert [r["v"] for r in found] == ["a/b", None, None, None, None, "a/b", None]


def test_folder_scan(spark, tmp_path):
    for name, content in {"a.txt": b"the cat", ".hidden": b"the", "_x": b"", "sub/b.txt": "für the".encode(), "bin/no.txt": b"x", "bad.dat": b"\xff\xfe\x00", "cut.txt": b"ok \xe2\x82", "big.txt": b"y " * 50}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    found = {r["rel_path"]: (r["status"], r["token_count"]) for r in f.scan(spark, str(tmp_path), catalog.word_level(), max_bytes=60).collect()}
    assert found == {"a.txt": ("Counted", 2), ".hidden": ("Counted", 1), "_x": ("Counted", 0), "sub/b.txt": ("Counted", 2), "bad.dat": ("SkippedBinary", None), "cut.txt": ("Counted", 2), "big.txt": ("SkippedSize", None)}
    counted = spark.createDataFrame([(k, s, n) for k, (s, n) in found.items()], "rel_path string, status string, token_count long")
    assert tuple(tree.scan_counters(counted).first()) == (5, 2, 0, 7)


def test_text_detection_agrees(spark):
    rng = random.Random(7)
    cases = [b"", b"abc", "é€😀".encode(), b"\xff", b"\x00", "é".encode()[:1], "€".encode()[:2], "😀".encode()[:3], b"a\xe2", b"\xed\xa0", b"\xf0\x80"]
    cases += [bytes(rng.choice(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xff") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(cases)], "k int, b binary")
    found = {r["k"]: (r["t"], r["s"]) for r in rows.select("k", f.is_text_column(F.col("b")).alias("t"), f.text_column(F.col("b")).alias("s")).collect()}
    assert {k: t for k, (t, _) in found.items()} == {k: f.is_text(b) for k, b in enumerate(cases)}
    assert {k: s for k, (_, s) in found.items()} == {k: f.decoded(b) for k, b in enumerate(cases)}


def test_change_events(spark):
    schema = "ts timestamp, seq long, kind string, rel_path string, is_directory boolean, old_path string"
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [(t, 1, "changed", "a/x", False, None), (t + timedelta(milliseconds=300), 2, "deleted", "a/x", False, None), (t, 3, "renamed", "n", False, "o"), (t, 4, "changed", "d", True, None), (t, 5, "created", "bin/x", False, None), (t + timedelta(seconds=5), 6, "created", "a/x", False, None)]
    found = refresh.sessions(refresh.wanted(spark.createDataFrame(rows, schema)))
    assert {(r["rel_path"], r["is_removal"], r["seq"]) for r in found.collect()} == {("a/x", True, 2), ("n", False, 3), ("o", True, 3), ("a/x", False, 6)}


def test_refresh_is_a_rebuild(spark, tmp_path):
    config = catalog.word_level()

    def write(name, text):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    def known(df):
        return {tuple(r) for r in df.select("rel_path", "length", "token_count").collect()}

    for name, text in {"a.txt": "a b", "d/x.txt": "x", "d/y.txt": "y y", "e/z.txt": "z", "gone.txt": "g"}.items():
        write(name, text)
    root = str(tmp_path / "root")
    before = f.scan(spark, root, config).where("status = 'Counted'").drop("status")
    before.write.parquet(str(tmp_path / "v1"))
    (tmp_path / "root" / "gone.txt").unlink()
    (tmp_path / "root" / "e" / "z.txt").unlink()
    (tmp_path / "root" / "d" / "x.txt").unlink()
    for name, text in {"a.txt": "a b c d", "d/new/w.txt": "w", "fresh.txt": "f f"}.items():
        write(name, text)
    rows = [("a.txt", False, False), ("gone.txt", False, True), ("e", True, True), ("d", True, False), ("fresh.txt", False, False), ("nowhere", True, False)]
    changed = spark.createDataFrame(rows, "rel_path string, is_directory boolean, is_removal boolean")
    after = refresh.refreshed(spark.read.parquet(str(tmp_path / "v1")), changed, root, config)
    assert known(after) == known(f.scan(spark, root, config).where("status = 'Counted'"))


def test_registry_and_settings(tmp_path):
    from tokenloom.sources.registry import Registry, Settings, format_bytes, speed

    r = Registry({"small": catalog.word_level()})
    r.register("bytes", catalog.byte_level())
    assert (r.active, r.describe("bytes").split(" · ")[0]) == ("small", "BPE")
    r.set_active("bytes")
    r.remove("bytes")
    assert r.active == "small"
    with pytest.raises(ValueError):
        r.remove("small")
    path = str(tmp_path / "settings.json")
    assert Settings.load(path) == Settings()
    Settings(max_bytes=5, active="x").save(path)
    assert Settings.load(path) == Settings(max_bytes=5, active="x")
    assert (format_bytes(1023), format_bytes(1536), speed(0, 0, 0), speed(2_100_000, 1024, 1)) == ("1023 B", "1.5 KB", "", "2.1M tokens/s · 1.0 KB/s")


def test_untagged_components():
    config = json.loads(catalog.byte_level())
    for part in ("pre_tokenizer", "decoder", "post_processor"):
        config[part] = {k: v for k, v in config[part].items() if k != "type"}
    assert Tokenizer(json.dumps(config)).encode("the é").ids == Tokenizer(catalog.byte_level()).encode("the é").ids


def test_stream_decoding(spark, tmp_path):
    config = catalog.byte_level()
    t = Tokenizer(config)
    texts = {1: "the é 😀 end", 2: "日本 der"}
    rows = [(s, k, i) for s, x in texts.items() for k, i in enumerate(t.encode(x).ids)]
    table = spark.createDataFrame(rows, "stream_id long, seq long, id int")
    steps = d.decode_steps(table, config, skip_special=False).collect()
    assert {s: "".join(r["text"] for r in sorted(steps, key=lambda r: r["seq"]) if r["stream_id"] == s) for s in texts} == texts
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = d.decode_stream(stream, config, skip_special=False).writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("decoded").collect()
    assert {s: "".join(r["text"] for r in sorted(out, key=lambda r: r["seq"]) if r["stream_id"] == s) for s in texts} == texts


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_agree_with_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    frame = catalog.QUERIES[name](spark, data)
    found = frame.toPandas()
    assert len(found)
    if name not in catalog.ORACLES:
        return
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "events", "benchmark"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    names = sorted(want.columns)
    assert names == sorted(found.columns)
    a, b = (x[names].astype(str).sort_values(names).reset_index(drop=True) for x in (want, found))
    assert a.equals(b)


def test_entry_points_without_the_pipeline_operators():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()
    assert os.path.exists(entry.__file__)
