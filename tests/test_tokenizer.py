import json
import os
import random

import pytest

from tokenloom.functions.encoding import Encoding, truncate_pair
from tokenloom.functions.models import Unigram
from tokenloom.functions.tokenizer import Spec, Tokenizer

FIXTURES = json.load(open(os.path.join(os.path.dirname(__file__), "fixtures", "pipelines.json"), encoding="utf-8"))
CASES = [(p["name"], json.dumps(p["config"]), v) for p in FIXTURES for v in p["vectors"]]


@pytest.mark.parametrize(("name", "config", "v"), CASES, ids=[f"{n}-{k}" for k, (n, _, _) in enumerate(CASES)])
def test_recorded_vectors(name, config, v):
    t = Tokenizer(config)
    if "pair" in v:
        e = t.encode(v["text"], v["pair"])
        assert (e.ids, e.type_ids) == (v["with_specials"], v["type_ids"])
        return
    e = t.encode(v["text"], add_special=False, unit="char")
    assert e.ids == v["ids"]
    assert e.tokens == v["tokens"]
    assert e.offsets == [tuple(o) for o in v["offsets"]]
    assert t.encode(v["text"]).ids == v["with_specials"]
    assert t.decode(v["ids"], skip_special=False) == v["decoded"]
    assert t.count(v["text"]) == len(v["ids"])


@pytest.mark.parametrize("p", FIXTURES, ids=[p["name"] for p in FIXTURES])
def test_json_round_trip(p):
    once = Spec.parse(json.dumps(p["config"])).json()
    assert Spec.parse(once).json() == once
    t, u = Tokenizer(once), Tokenizer(json.dumps(p["config"]))
    assert t.vocab() == u.vocab()


@pytest.mark.parametrize("p", FIXTURES, ids=[p["name"] for p in FIXTURES])
def test_count_is_length(p):
    t, rng = Tokenizer(json.dumps(p["config"])), random.Random(12345)
    for _ in range(100):
        text = "".join(rng.choice("aeHthlo \n\t,.12é你😀<>[]mrk▁") for _ in range(rng.randint(0, 40)))
        assert t.count(text) == len(t.encode(text, add_special=False)) == len(t.encode(text, add_special=False, unit="none"))


def words(n, **parts):
    vocab = {w: k for k, w in enumerate("abcdefghij"[:n])} | {"<unk>": n}
    return json.dumps({"model": {"type": "WordLevel", "vocab": vocab}, "pre_tokenizer": {"type": "WhitespaceSplit"}} | parts)


def truncated(most, **more):
    return {"max_length": most, "stride": 0, "strategy": "LongestFirst", "direction": "Right"} | more


def test_truncation():
    text = "a b c d e f g h i j"
    assert Tokenizer(words(10, truncation=truncated(3))).encode(text).ids == [0, 1, 2]
    assert Tokenizer(words(10, truncation=truncated(3, direction="Left"))).encode(text).ids == [7, 8, 9]
    assert Tokenizer(words(10, truncation=truncated(6))).encode(text, text).ids == [0, 1, 2, 0, 1, 2]
    with pytest.raises(ValueError):
        truncate_pair(Tokenizer(words(10)).encode("a b c d"), None, 3, 0, "onlysecond", "right")
    e = Encoding(list(range(5)), [0] * 5, [""] * 5, [None] * 5, [(0, 0)] * 5, [0] * 5, [1] * 5)
    e.truncate(3, 1)
    assert (e.ids, [o.ids for o in e.overflow]) == ([0, 1, 2], [[2, 3, 4]])
    with pytest.raises(ValueError):
        e.truncate(2, 2)


def test_padding():
    pad = {"strategy": "BatchLongest", "direction": "Right", "pad_to_multiple_of": 4, "pad_id": 9, "pad_type_id": 0, "pad_token": "[PAD]"}
    a, b = Tokenizer(words(10, padding=pad)).encode_batch(["a b", "a b c d e"])
    assert a.ids == [0, 1] + [9] * 6
    assert (a.attention, a.special) == ([1, 1] + [0] * 6, [0, 0] + [1] * 6)
    assert len(b) == 8


def test_positions():
    e = Tokenizer(words(10)).encode("a bb c", add_special=False)
    assert (e.char_to_token(2), e.char_to_word(2), e.char_to_token(1)) == (1, 1, None)
    assert (e.word_to_tokens(2), e.word_to_chars(1), e.token_to_chars(0)) == ((2, 3), (2, 4), (0, (0, 1)))


def test_stream_decoder_holds_incomplete_characters():
    vocab = {"<0x20>": 0, "<0xC3>": 1, "<0xA9>": 2, " This": 3}
    config = {"model": {"type": "BPE", "vocab": vocab, "merges": [], "byte_fallback": True}, "decoder": {"type": "ByteFallback"}}
    s = Tokenizer(json.dumps(config)).stream(skip_special=False)
    assert [s.step(i) for i in (0, 1, 2, 3)] == [" ", None, "é", " This"]


def test_unigram_paths():
    u = Unigram({"vocab": [["<unk>", 0.0], ["a", -1.0], ["b", -1.5], ["ab", -2.0]], "unk_id": 0})
    assert [i for i, *_ in u.best("ab")] == [3]
    assert [[i for i, *_ in p] for p in u.n_best("ab", 2)] == [[3], [1, 2]]
    assert u.n_best("ab", 0) == []
    total, counts = u.marginals("ab")
    assert abs(sum(counts[k] for k in (1, 3)) - 1) < 1e-9
    assert counts[1] == pytest.approx(counts[2])


def test_errors():
    with pytest.raises(ValueError):
        Spec.parse('{"version": "2.0", "model": {}}')
    with pytest.raises(ValueError):
        Spec.parse("{}")
    with pytest.raises(ValueError):
        Tokenizer('{"model": {"type": "Other", "vocab": {}}}')
    with pytest.raises(ValueError):
        Tokenizer('{"model": {"type": "WordLevel", "vocab": {"a": 0}}}').encode("b")
