"""Whole columns against the kernels, streams, truncation as a property, and places of tokens in lines."""

import json
import os
import random
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom import catalog
from tokenloom.functions import columns as c
from tokenloom.functions.encoding import Encoding, truncate_pair
from tokenloom.functions.models import Bpe
from tokenloom.functions.text import by_script, simple_lower, Text
from tokenloom.functions.tokenizer import AddedToken, Spec, Tokenizer
from tokenloom.operators import encode as e
from tokenloom.sources import files as f

sys.path.insert(0, os.path.dirname(__file__))

ODD = [None, "", " ", "a  b", "a\n b", "\nx y", "the one <s> of", "trail ", " lead", "x\x1cy z", "don't one's", "12 3４ é中😀"]


def adding(config: str, *contents: str) -> str:
    return Spec.parse(config).adding(*contents, special=True).json()


@pytest.mark.parametrize("config", [catalog.byte_level(), catalog.merging(), adding(catalog.merging(), "<s>", "of"), catalog.merging().replace('"add_prefix_space": false', '"add_prefix_space": true')], ids=["small", "merging", "added", "prefix"])
def test_batches_agree_with_kernels(config):
    t, rng = Tokenizer(config), random.Random(3)
    texts = ODD + ["".join(rng.choice("the one on of aé😀\n\t 12.'s中<>") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    w, table = t.words(), t.id_bytes(True)
    for _ in range(2):  # new words, then known ones
        ids, counts = w.encode(pa.array(texts))
        ends = np.concatenate([[0], np.cumsum(counts)])
        want = [t.encode(x or "", add_special=False, unit="none").ids for x in texts]
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
        assert w.count(pa.array(texts)).tolist() == list(map(len, want))
    lists = pa.array([*want, None, [10**6], [200, 3], [255, 255]], pa.list_(pa.int32()))
    assert table.texts(lists).to_pylist() == [t.decode(x or []) for x in lists.to_pylist()]
    assert table.texts(lists.slice(5, 3)).to_pylist() == [t.decode(x) for x in want[5:8]]


def test_counts_are_the_librarys(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    path = catalog.public_tokenizer("byte_bpe_50k.json")
    if not path:
        pytest.skip("no public tokenizer here")
    lib = tokenizers.Tokenizer.from_file(path)
    found = {r["doc_id"]: r["n_tokens"] for r in catalog.count_bpe_tokens(spark, data).collect()}
    rows = catalog.load(spark, data).collect()
    assert found == {r["doc_id"]: len(lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows}


def test_long_words_are_merged_in_time():
    model = Bpe({"vocab": {"a": 0, "aa": 1, "aaaa": 2, "b": 3}, "merges": ["a a", "aa aa"]})
    began = time.time()
    assert [i for i, *_ in model.merged("a" * 200_001)] == [2] * 50_000 + [0]
    assert time.time() - began < 20
    assert model.merged("aabaa") == [(1, "aa", 0, 2), (3, "b", 2, 3), (1, "aa", 3, 5)]


def plain(n):
    return Encoding(list(range(n)), [0] * n, [""] * n, [None] * n, [(0, 0)] * n, [0] * n, [1] * n)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(1, 40))
def test_longest_first_takes_from_the_longer(n, m, most):
    a, b = plain(n), plain(m)
    truncate_pair(a, b, most, 0, "longestfirst", "right")
    if n + m <= most:
        assert (len(a), len(b)) == (n, m)
        return
    assert len(a) + len(b) == most
    shorter, longer = (len(b), len(a)) if n > m else (len(a), len(b))
    assert shorter == min(n, m, most // 2)
    assert longer >= shorter or min(n, m) == 0


def test_streams_give_out_the_text():
    rng = random.Random(4)
    for config in (catalog.byte_level(), catalog.unigram(), catalog.word_piece(), catalog.falling_back(), catalog.suffixed()):
        t = Tokenizer(config)
        for _ in range(40):
            letters = "é😀a 中" if config in (catalog.byte_level(), catalog.falling_back()) else "the abc"
            ids = t.encode("".join(rng.choice(letters) for _ in range(12)).strip()).ids
            s = t.stream(skip_special=False)
            assert "".join(s.step(i) or "" for i in ids) == t.decode(ids, skip_special=False)
    s = Tokenizer(catalog.byte_level()).stream()
    assert [s.step(i) for i in "é".encode()] == [None, "é"]
    assert (s.context, s.pending) == (list("é".encode()), [])


def test_simple_case_map_and_scripts():
    assert [simple_lower(x) for x in "İΣAẞé"] == ["İ", "σ", "a", "ß", "é"]

    def parts(text):
        return [p.chars for p in by_script(Text(text, None))]

    assert parts("ꦗꦮ" + "abc") == ["ꦗꦮ", "abc"]  # Javanese
    assert parts("𞤀𞤣ab") == ["𞤀𞤣", "ab"]  # Adlam
    assert parts("ᐃᓄab") == ["ᐃᓄ", "ab"]  # Canadian Aboriginal
    assert parts("かな漢字カナー") == ["かな漢字カナー"]


def test_running_bytes_of_many_pieces(spark):
    rng = random.Random(5)
    pieces = [["é" * rng.randint(0, 3) for _ in range(n)] for n in (0, 1, 511, 512, 513, 3000)]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pieces)], "k int, p array<string>").select("k", c.running_bytes(F.col("p")).alias("s")).collect()
    for k, spans in rows:
        ends = np.cumsum([len(x.encode()) for x in pieces[k]]).tolist()
        assert [tuple(x) for x in spans] == list(zip([0, *ends], ends))


def test_lines_of_rows_with_one_key(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "c\r\nd\r"), (2, None)], "doc_id long, text string")
    found = sorted(tuple(r) for r in e.lines(df).collect())
    assert found == sorted([(1, 0, "a", 0, 1), (1, 1, "b", 2, 3), (1, 0, "c", 0, 1), (1, 1, "d", 3, 4), (1, 2, "", 5, 5), (2, 0, "", 0, 0)])


def test_tokens_of_lines(spark):
    rng = random.Random(6)
    texts = ["the one\non of\n\nx", "", "\n", "abc"] + ["".join(rng.choice("one the\n ") for _ in range(50)) for _ in range(30)]
    config = catalog.merging()
    found = {(r["doc_id"], r["line_no"]): r for r in e.line_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), config).collect()}
    for k, text in enumerate(texts):
        places, at = Tokenizer(config).encode(text, add_special=False, unit="char").offsets, 0
        for n, line in enumerate(text.split("\n")):
            inside = [i for i, (a, b) in enumerate(places) if a < at + len(line) and b > at]
            r = found[k, n]
            assert (r["first_token"], r["last_token"]) == ((inside[0], inside[-1]) if inside else (None, None))
            at += len(line) + 1


def test_spec_changes_and_files(tmp_path):
    spec = Spec.parse(catalog.merging()).adding("<s>", AddedToken("new", single_word=True), "<s>", special=True)
    assert [t.content for t in spec.added_tokens] == ["<s>", "new"]
    spec.save(str(tmp_path / "t.json"))
    t = Tokenizer(Spec.load(str(tmp_path / "t.json")))
    assert (t.token_to_id("<s>"), t.token_to_id("new")) == (258, 259)
    assert t.encode("a new <s>newer").ids[-1] != 259
    assert t.decode_chain(t.encode("one é").ids) == ["one é"]
    assert Tokenizer(json.dumps(json.loads(catalog.merging()) | {"decoder": None})).decode_chain([257, 0]) == ["one", "Ā"]


def test_deep_and_wide_folders(spark, tmp_path):
    want = set()
    for k in range(40):
        path = tmp_path / "a" / f"w{k}" / "deep" / "er"
        path.mkdir(parents=True)
        for name in ("x.txt", "Ünï", ".z"):
            (path / name).write_text("the one")
            want.add(f"a/w{k}/deep/er/{name}")
        (tmp_path / "a" / f"w{k}" / "node_modules").mkdir()
        (tmp_path / "a" / f"w{k}" / "node_modules" / "no").write_text("x")
    spark.dataSource.register(f.FolderSource)
    for tasks in ("1", "3", "64", "1000"):
        rows = spark.read.format("folder").option("folders", "node_modules").option("tasks", tasks).load(str(tmp_path)).collect()
        assert {r["rel_path"] for r in rows} == want and len(rows) == len(want)
    below = spark.read.format("folder").option("below", "a/w3\na/w5/deep\na/none").load(str(tmp_path)).collect()
    assert {r["rel_path"] for r in below} == {w for w in want if w.startswith(("a/w3/", "a/w5/"))}


def test_components_named_by_where_they_are():
    config = {"model": {"type": "custom_parts:Vowels", "vowels": "AEIOU"}, "normalizer": {"type": "custom_parts:swap"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "decoder": {"type": "custom_parts:joined"}}
    t = Tokenizer(json.dumps(config))
    assert t.encode("a be Oi", add_special=False).ids == [0, 1, 2]
    assert t.decode([0, 1, 4]) == "A-E-U"
    with pytest.raises(ValueError):
        Tokenizer(json.dumps(config | {"decoder": {"type": "custom_parts:nothing"}}))


def test_profile_and_cache_stats():
    t = Tokenizer(catalog.merging())
    p = t.profile("one on\n one")
    assert (p["bytes"], p["tokens"]) == (11, t.count("one on\n one"))
    assert set(p) == {"bytes", "tokens", "added", "normalize", "words", "model"}
    fresh = Bpe({"vocab": {"a": 0}, "merges": []})
    for word in ("a", "a", "aa", "a" * 300):
        fresh.tokens(word)
    assert fresh.cache_stats() == {"hits": 1, "misses": 3, "skips": 1, "evictions": 0, "kept": 2}


def test_template_strings():
    from tokenloom.functions.encoding import template_pieces, template_string

    assert template_string(template_pieces("[CLS] $A [SEP] $B:1 [SEP]:1")) == "[CLS] $A [SEP] $B:1 [SEP]:1"


def test_children_are_in_utf16_order(spark):
    from tokenloom.plans import tree

    names = ["b", "a", "\uff5c", "😀", "B", "aa/x"]
    found = tree.with_order(tree.roll_up(spark.createDataFrame([(n, 1, 1) for n in names], "rel_path string, length long, token_count int")))
    got = [r["name"] for r in found.where("parent_path = ''").orderBy("child_no").collect()]
    assert got == ["B", "a", "aa", "b", "😀", "\uff5c"]


def test_positions_as_columns(spark):
    t = Tokenizer(catalog.merging())
    texts = ["one on the", "", "é one"]
    rows = e.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), catalog.merging(), unit="char")
    at = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("p"), "offsets", "words")
    got = at.select("doc_id", "p", c.token_at(F.col("offsets"), F.col("p")).alias("t"), c.word_at(F.col("offsets"), F.col("words"), F.col("p")).alias("w"), c.tokens_of_word(F.col("words"), F.col("p")).alias("of"), c.chars_of_word(F.col("offsets"), F.col("words"), F.col("p")).alias("chars")).collect()
    for r in got:
        enc = t.encode(texts[r["doc_id"]], add_special=False, unit="char")
        assert (r["t"], r["w"]) == (enc.char_to_token(r["p"]), enc.char_to_word(r["p"]))
        assert (tuple(r["of"]) if r["of"] else None) == enc.word_to_tokens(r["p"])
        assert (tuple(r["chars"]) if r["chars"] else None) == enc.word_to_chars(r["p"])


def test_change_stream_and_overflow(spark, tmp_path):
    from datetime import datetime, timedelta

    from tokenloom.streaming import refresh

    schema = "ts timestamp, seq long, kind string, rel_path string, is_directory boolean, old_path string"
    t = datetime(2024, 1, 1)
    rows = [(t, 1, "changed", "a/x", False, None), (t + timedelta(milliseconds=300), 2, "deleted", "a/x", False, None), (t + timedelta(seconds=5), 3, "overflow", None, None, None), (t + timedelta(seconds=60), 4, "created", "z", False, None), (t + timedelta(seconds=120), 5, "created", "y", False, None)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = refresh.session_stream(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    found = {(r["rel_path"], r["is_removal"], r["seq"]) for r in spark.table("changes").collect()}
    assert found == {("a/x", True, 2), ("", False, 3), ("z", False, 4)}
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "n.txt").write_text("one two")
    old = spark.createDataFrame([("gone", 1, 1)], "rel_path string, length long, token_count long")
    lost = spark.createDataFrame([("", True, False)], "rel_path string, is_directory boolean, is_removal boolean")
    assert [tuple(r) for r in refresh.refreshed(old, lost, str(tmp_path / "root"), catalog.word_level()).collect()] == [("n.txt", 7, 2)]
