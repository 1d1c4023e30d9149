"""Operators on full batches: what comes out in one go is bounded, distinct words are worked on once, and results stay those of the kernels."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom import catalog
from tokenloom.functions import columns as c
from tokenloom.functions import batches, models, text
from tokenloom.functions.text import pre_tokenizer, Text
from tokenloom.functions.tokenizer import _COMPILED, compiled, Tokenizer
from tokenloom.operators import encode as e

ODD = ["", " ", " a", "a  b ", "\nx y", "the <s> of", "other", "don't one's", "12 3４ é中😀", "a\r\nb\n", "▁ a"]


def many(n=800):
    rng = random.Random(1)
    words = ["the", "other", "one", "thé😀", "x7", "don't", "a,b", "of\nto"] + ["".join(rng.choice("thexyz") for _ in range(6)) for _ in range(300)]
    return ODD + [" ".join(rng.choice(words) for _ in range(500)) for _ in range(n)]


def kernels(spark, monkeypatch, make):
    """The functions that a plan's Python workers run, in turn."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: found.append(f) or spark.createDataFrame([], schema))
        make()
    return found


def through(kernel, table):
    """One full batch through a worker's function."""
    return list(kernel(iter(table.combine_chunks().to_batches())))


def texts_table(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "_text": pa.array(texts, pa.string())})


def test_byte_level_spans_of_a_full_batch(spark, monkeypatch, data):
    texts, t = many(), Tokenizer(catalog.byte_level())
    kernel = kernels(spark, monkeypatch, lambda: catalog.byte_level_spans(spark, data))[-1]
    out = through(kernel, texts_table(texts))
    assert len(out) > 3 and out[0].schema.names == ["doc_id", "token_no", "id", "start", "end", "odd"]
    rows = pa.Table.from_batches(out)
    held = rows.filter(pa.compute.less(rows["doc_id"], 30)).to_pylist()
    want = []
    for k, x in enumerate(texts[:30]):
        found = t.encode(x, add_special=False, unit="utf16")
        want += [{"doc_id": k, "token_no": n, "id": i, "start": a, "end": b, "odd": n % 2 == 1} for n, (i, (a, b)) in enumerate(zip(found.ids, found.offsets))]
    assert held == want


ROUND_TRIPS = {"byte_fallback_round_trip": catalog.falling_back, "word_piece_round_trip": catalog.word_piece, "unigram_round_trip": catalog.unigram, "suffix_round_trip": catalog.suffixed, "byte_level_round_trip": catalog.byte_level}


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_round_trips_of_a_full_batch(spark, monkeypatch, data, name):
    texts = many() if name.startswith("byte") else [re.sub("[^a-z]+", " ", x).strip() for x in many()]
    t = Tokenizer(ROUND_TRIPS[name]())
    coding, decoding = kernels(spark, monkeypatch, lambda: catalog.QUERIES[name](spark, data))
    calls = []
    monkeypatch.setattr(type(t.model), "tokens", lambda self, word, f=type(t.model).tokens: calls.append(word) or f(self, word))
    coded = pa.Table.from_batches(through(coding, texts_table(texts)))
    assert len(calls) < 10_000  # of 400,000 words
    assert coded["ids"].to_pylist()[::40] == [t.encode(x, unit="none").ids for x in texts[::40]]
    out = through(decoding, coded.select(["doc_id", "ids"]))
    assert len(out) > 3 and max(len(b.column("ids").flatten()) for b in out) <= e.PART
    assert pa.Table.from_batches(out)["decoded"].to_pylist() == texts


@pytest.mark.parametrize(("name", "config"), [
    ("words_then_digits", {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": True}]}),
    ("letter_runs", {"type": "Split", "pattern": {"Regex": r"\p{L}+"}, "behavior": "Isolated", "invert": False}),
    ("bert_words", {"type": "BertPreTokenizer"}),
])
def test_pieces_of_a_full_batch(spark, monkeypatch, data, name, config):
    texts, cut = many(), pre_tokenizer(config)
    out = through(kernels(spark, monkeypatch, lambda: catalog.QUERIES[name](spark, data))[-1], texts_table(texts))
    assert len(out) > 3 and max(len(b) for b in out) < len(texts) / 3
    found = pa.Table.from_batches(out)["words"].to_pylist()
    assert found[:200] == [[p.chars for p in cut(Text(x, None)) if p.chars] for x in texts[:200]]


@pytest.mark.parametrize("invert", [False, True])
@pytest.mark.parametrize("behavior", ["Isolated", "Removed", "Contiguous", "MergedWithPrevious", "MergedWithNext"])
@pytest.mark.parametrize("find", [r"\p{L}+", r"\s", r"(a)|b", r"a*", r"(?=a)", r"a|(?<=x)", r"\b"])
def test_pieces_as_strings(monkeypatch, find, behavior, invert):
    config, rng = {"type": "Split", "pattern": {"Regex": find}, "behavior": behavior, "invert": invert}, random.Random(5)
    kernel, quick = pre_tokenizer(config), text.piece_strings(config)
    texts = ODD + ["".join(rng.choice("aabx 1é😀\n,") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    want = [[p.chars for p in kernel(Text(x, None)) if p.chars] for x in texts]
    monkeypatch.setattr(text, "Text", None)  # none is made for a piece
    assert list(map(quick, texts)) == want


@pytest.mark.parametrize(("name", "column"), [("words_of_encodings", "words"), ("added_tokens", "ids")])
def test_encodings_of_a_full_batch(spark, monkeypatch, data, name, column):
    texts = many()
    config = json.loads(catalog.word_level()) | ({"added_tokens": [{"id": 0, "content": "the", "special": True, "normalized": False}]} if name == "added_tokens" else {})
    t = Tokenizer(json.dumps(config))
    calls = []
    monkeypatch.setattr(models.WordLevel, "tokens", lambda self, word, f=models.WordLevel.tokens: calls.append(word) or f(self, word))
    out = through(kernels(spark, monkeypatch, lambda: catalog.QUERIES[name](spark, data))[-1], texts_table(texts))
    assert len(calls) < 10_000 and len(out) > 3
    assert pa.Table.from_batches(out)[column].to_pylist()[:100] == [getattr(t.encode(x), column) for x in texts[:100]]


def test_lines_of_a_full_batch(spark, monkeypatch, data):
    texts = many()
    out = through(kernels(spark, monkeypatch, lambda: catalog.text_lines(spark, data))[-1], texts_table(texts))
    assert len(out) > 3
    rows = pa.Table.from_batches(out)
    joined = {}
    for k, line in zip(rows["doc_id"].to_pylist(), rows["line"].to_pylist()):
        joined.setdefault(k, []).append(line)
    assert joined == {k: re.split("\r\n|\n|\r", x) for k, x in enumerate(texts)}


def test_counts_of_a_full_batch(spark, monkeypatch, data):
    texts = [re.sub("[^a-z]+", " ", x).strip() for x in many()]
    calls = []
    monkeypatch.setattr(models.WordPiece, "tokens", lambda self, word, f=models.WordPiece.tokens: calls.append(word) or f(self, word))
    (out,) = through(kernels(spark, monkeypatch, lambda: catalog.word_piece_counts(spark, data))[-1], texts_table(texts))
    assert len(calls) < 10_000
    assert out.column(1).to_pylist() == [len(x.replace(" ", "")) - x.count("th") for x in texts]


def test_running_bytes_works_its_pieces_out_once(spark):
    texts = ["", "a1é22b" * 700, "x", "1" * 5000, "a1" * 3000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", c.running_bytes(c.digits(F.col("text"))).alias("p"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract_all") == 1
    found = {r["doc_id"]: r["p"] and [(s["start"], s["end"]) for s in r["p"]] for r in rows.collect()}
    for k, x in enumerate(texts[:-1]):
        ends = np.cumsum([len(p.encode()) for p in re.findall(r"\d+|\D+", x)]).tolist()
        assert found[k] == list(zip([0, *ends], ends))


@pytest.mark.parametrize("unit", ["byte", "char", "utf16", "none"])
@pytest.mark.parametrize("name", ["word_piece", "unigram", "suffixed", "falling_back", "byte_level", "merging", "word_level"])
def test_chunks_agree_with_kernels(name, unit):
    t, rng = Tokenizer(getattr(catalog, name)()), random.Random(3)
    texts = ODD + ["".join(rng.choice("the one aé😀\n\t 12.'中▁́  TH") for _ in range(rng.randint(1, 60))) for _ in range(100)]
    chunks = t.chunks(unit, tuple(e.PARTS))
    for given in (texts, texts[::-1]):  # new chunks, then known ones
        ends, flat = chunks.encode(given, tuple(e.PARTS))
        flat = {k: v.to_pylist() for k, v in flat.items()}
        for x, a, b in zip(given, ends, ends[1:]):
            want = t.encode(x, unit=unit)
            assert {k: [(o["start"], o["end"]) for o in v[a:b]] if k == "offsets" else v[a:b] for k, v in flat.items()} == {k: getattr(want, k) for k in flat}
    lists = [[rng.randrange(-1, len(t.model.vocab) + 2) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    assert t.id_bytes(True).texts(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [t.decode(x) for x in lists]


@pytest.mark.parametrize("name", ["word_piece_round_trip", "letter_runs", "unigram_round_trip", "suffix_round_trip", "words_of_encodings", "bert_words", "added_tokens"])
def test_workers_get_bounded_batches(spark, monkeypatch, tmp_path, name):
    # 8 MB in one partition.
    spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the other one "), 1430).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    run = type(spark.range(0)).mapInArrow

    def watched(self, f, schema):
        def worker(batches):
            def seen():
                for b in batches:
                    if len(b) > 1 and b.nbytes > 5_000_000:
                        raise ValueError(f"{b.nbytes} bytes at once")
                    yield b

            return f(seen())

        return run(self, worker, schema)

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.unset(setting)
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    try:
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 400
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


@pytest.mark.parametrize("name", ["unigram", "suffixed"])
def test_words_are_remembered_once(name):
    t = Tokenizer(getattr(catalog, name)())
    texts = [f"the {a}{b}{c}" for a in "thexyz" for b in "thexyz" for c in "thexyz"]
    t.chunks("none", ("ids",)).encode(texts, ("ids",))
    assert not t.model.known and len(t.chunks("none", ("ids",)).later) > 200


@pytest.mark.parametrize("name", ["words_of_encodings", "added_tokens", "bert_words", "byte_level_round_trip"])
def test_long_chunks_are_not_all_remembered(spark, monkeypatch, data, name):
    held = []
    for kind in (batches.Chunks, batches.WordBatches):
        monkeypatch.setattr(kind, "coded", lambda self, x, f=kind.coded: held.append(self) or f(self, x))
    texts = [f"{k}" + "the" * 60_000 for k in range(100)]  # 18 MB without a space
    for _ in through(kernels(spark, monkeypatch, lambda: catalog.QUERIES[name](spark, data))[0], texts_table(texts)):
        assert sum(len(x or "") for x in [*held[-1].later, *held[-1].first]) <= batches.ENTRIES + e.PART
    assert held


def test_only_the_latest_tokenizer_remembers():
    """A worker goes from query to query; what it remembers doesn't add up."""
    texts = [f"the {a}{b}" for a in "thexyz" for b in "thexyz"]
    for make in (catalog.suffixed, catalog.unigram, catalog.word_level, catalog.suffixed):
        for want in (("ids",), ("ids", "words")):
            compiled(make()).chunks("byte", want).encode(texts, want)
            kept = [x for t in _COMPILED.values() for x in t._chunks.values() if x and len(x.later) > 1]
            assert kept == [compiled(make()).chunks("byte", want)]
    compiled(catalog.byte_level()).words().encode(pa.array(texts))
    compiled(catalog.suffixed())
    assert not compiled(catalog.byte_level()).words().later


@pytest.mark.parametrize("flags", [{"normalized": False}, {"normalized": True}, {"single_word": True}])
@pytest.mark.parametrize("name", ["word_level", "suffixed", "unigram", "word_piece"])
def test_plain_words_beside_added_tokens(monkeypatch, name, flags):
    config = json.loads(getattr(catalog, name)()) | {"added_tokens": [{"id": 0, "content": "The"} | flags]}
    if name != "unigram":
        config["normalizer"] = {"type": "Lowercase"}
    t, texts = Tokenizer(json.dumps(config)), [" ".join(f"{a}{b}{c}" for b in ("the", "The", "x7")) for a in ("", "o", "é", "The") for c in ("", "r", "the", "THE", ",")]
    calls = []
    monkeypatch.setattr(Tokenizer, "pieces", lambda self, x, track=True, f=Tokenizer.pieces: calls.append(x) or f(self, x, track))
    for unit in ("byte", "none"):
        chunks = t.chunks(unit, ("ids", "offsets"))
        ends, flat = chunks.encode(texts, ("ids", "offsets"))
        known = len(calls)
        got = [(flat["ids"].to_pylist()[a:b], [(o["start"], o["end"]) for o in flat["offsets"].to_pylist()[a:b]]) for a, b in zip(ends, ends[1:])]
        assert got == [(x.ids, x.offsets) for x in map(lambda x: t.encode(x, unit=unit), texts)]
        assert "or" not in {x.strip() for x in calls[:known]} and "ox7r" not in {x.strip() for x in calls[:known]}
        calls.clear()
