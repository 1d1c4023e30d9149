"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and no rows."""

import hashlib
import html
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bpe, context_mixing, exact_dedup, html_text, language_id, near_dedup, packing, quality_model, quality_rules, warc
from tokenloom.llm.common import bucket_of, components, salted_join, small_batches, stored
from tokenloom.llm.queries import tokenizer
from tokenloom.llm.shingles import bytes_of, shingle_sets, words

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, Text_ string, n_tokens int, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts; columns beside them have names that operators also use."""
    small_batches(spark)
    rng = random.Random(3)
    words = "the and of reth onan ti éa ñdo über Stra%%% XX!! 12 it's".split()
    texts = [None, "", " ", "a", "a b", "a  b", "a\tb\n", "<|endoftext|> x <|endoftext|>", "中文 text 😀", "word " * 3000, "x" * 9000, "\n".join(["one line"] * 5), "İΣς ﬁ", " lead", "trail "]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    base = [f"w{k}" for k in range(300)]
    for k in range(12):
        some = list(base)
        some[k * 20] = "edit"
        texts.append(" ".join(some))
    texts += texts[20:24] + [" ".join(base).upper()]
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts)]
    rows += [rows[20], (None, "null key", "x", 1, "y"), (None, texts[21], "x", 1, "y")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def words_of(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_is_the_library(docs, name):
    pytest.importorskip("public_tokenizers")
    config = tokenizer(name)
    lib = tokenizers.Tokenizer.from_str(config)
    coded = bpe.decode(bpe.encode(docs.withColumn("k", F.monotonically_increasing_id()), config, keep=("doc_id", "text")), config).collect()
    assert len(coded) == docs.count()
    for r in coded:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        if name.startswith("byte"):
            assert r["decoded"] == lib.decode(want, skip_special_tokens=False) == (r["text"] or "")


def test_bpe_pair_test_and_merging_agree():
    pytest.importorskip("public_tokenizers")
    m = bpe.load(tokenizer("byte_bpe_50k.json")).merges
    rng = random.Random(5)
    words = ["".join(rng.choice("abehinorst .!") for _ in range(rng.randint(1, 90))).encode() for _ in range(2000)]
    found, failed = m.encode_words(words)
    assert 0 < failed < len(words)
    for w, ids in zip(words, found):
        assert ids == m.merge(w.decode("latin-1").translate(bpe.TO_GLYPH))


def test_packing_keeps_every_token(docs):
    pytest.importorskip("public_tokenizers")
    config = tokenizer("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_str(config)
    out = packing.pack_documents(docs, config, size=256).collect()
    want = Counter()
    for key, text in rows_of(docs):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 256):
            piece = ids[at : at + 256]
            want[key, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 256
    assert sorted(filled) == list(range(len(filled)))
    assert packing.pack_documents(docs.limit(0), config).count() == 0


def test_shortest_pack_first_places_all():
    rng = random.Random(1)
    histogram = {k: rng.randint(1, 50) for k in range(1, 101)}
    patterns = packing.shortest_pack_first(histogram, 100)
    assert sum((Counter({n: c * p.count(n) for n in set(p)}) for c, p in patterns), Counter()) == Counter(histogram)
    assert all(sum(p) <= 100 for _, p in patterns)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div><article class="post"><header><h2>T&eacute;st &amp; more</h2></header>
<p>One <b>two</b>&nbsp;three<br>four<p>Five<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form>no</form><aside>side</aside>
<div class="comments"><p>c1</div></article><footer>f</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Tést & more\nOne two three four\nFive\na\nb\nc\nd"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<body><p>cut <b>off &am") == "cut off &am"
    assert html_text.main_text("a < b <!-- c --> d <a href='x>y'>e</a><textarea>z</textarea>") == "a < b d e"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_parts_by_name():
    t = html_text.main_text
    assert t("<article><div class='entry-header'><h1>T</h1></div><p>b</p><div class='site-footer'>f</div></article>") == "T\nb"
    assert t("<div class='page-header'>H</div><p>b") == "b"
    assert t("<p hidden>h</p><p class='visually-hidden-no'>v</p><a href='/hidden'>l</a><p style='display: none'>n</p>") == "v\nl"
    assert t("<article>a<article class='comment'>c</article></article>") == "a"
    assert t("<main><div role='navigation'>n</div>m</main>x") == "m"


def test_text_around_hidden_parts():
    t = html_text.main_text
    assert t("<article><p>Hello <span class='social'>x</span> world</p></article>") == "Hello world"
    for part in ("<script>x</script>", "<button>x</button>", "<label>x</label>", "<svg><text>x</text></svg>", "<style>x</style>", "<select><option>x</select>"):
        assert t(f"<p>One {part} two</p>") == "One two"
    assert t("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == "where x=1 holds"
    assert t("<article><div class='modal verbs'>can</div><p class='notice'>seen</p><div class='ad'>buy</div></article>") == "can\nseen"
    assert t("<div class='notice'>n</div><p>b</p>") == "b"
    assert t("<body><article>one</article><p>between</p><article>two</article></body>") == "one\ntwo"
    assert t("<main><article>teaser</article><p>" + "long text " * 20 + "</p></main>").startswith("teaser\nlong text")
    assert t("<body><article>in" + "<span>" * 600 + "deep</article>out</body>") == "indeep"
    assert t("<td>" * 700 + "</b>x") == "x"


def test_templates_carry_alone(spark):
    """Without any name, menus and footers go because they recur; a part of an article that names itself goes if it recurs."""
    nav = "<ul><li><a href=x>Home</a></li><li>News {}</li></ul>"
    pages = [(k, "http://h.example/", f"<div>{nav.format(k % 2)}</div><p>Text {k}</p><div>Imprint</div>") for k in range(60)]
    pages += [(100 + k, "http://n.example/", f"<article><p>Own {k}</p><div class='notice'>Read more</div><p class='notice'>Once {k}</p></article>") for k in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    known = {r["host"]: frozenset(map(bytes, r["template"])) for r in html_text.templates(df).collect()}
    for k, url, html in pages:
        page = html_text.Page(html, known[url[7:-1]], by_name=False)
        assert page.matched
        assert page.main_blocks() == ([f"Text {k}"] if k < 100 else [f"Own {k - 100}", f"Once {k - 100}"])


def test_odd_pages(spark):
    """Clashing columns, repeated rows, nulls in every column, a very long page."""
    long = "<body><article>" + "".join(f"<p>part {k}</p>" for k in range(60_000)) + "</article></body>"
    rows = [(1, "http://a/", "<p>x</p>", "c", "d"), (1, "http://a/", "<p>x</p>", "c", "d"), (None, None, None, None, None), (2, "::", "<p>y", None, "d"), (3, "http://a/", long, "c", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, template string")
    found = sorted(((r["page_id"] or 0, r["text"]) for r in html_text.extract(df).collect()), key=lambda r: r[0])
    assert found[:4] == [(0, ""), (1, "x"), (1, "x"), (2, "y")]
    assert found[4][1] == "\n".join(f"part {k}" for k in range(60_000))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_pages_of_the_table(spark):
    """On the whole table: what the generator put between the article's tags, by brute force, and templates that do something."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    known = {r["host"]: frozenset(map(bytes, r["template"])) for r in html_text.templates(df).collect()}
    matched = 0
    for r in df.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"<(?:!--.*?--|/?b|a [^>]*|/a|i|/i|em|/em|strong|/strong|br|span|/span)>", lambda m: " " if m[0] == "<br>" else "", body, flags=re.S)
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", blocks)]
        assert found[r["page_id"]] == "\n".join(x for x in want if x)
        host = re.match(r"(?:\w+:)?//([^/?#:]*)", r["url"])
        matched += html_text.Page(r["html"], known.get(host[1].lower(), frozenset()) if host else frozenset()).matched > 0
    assert matched > 0


def test_site_templates(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div>Site slogan</div><p>Body number {k}</p><div>Call us</div></body>") for k in range(40)]
    pages += [(100 + k, f"http://h.example/c{k}", f"<!-- {k} --><body><p>Same copy</p></body>") for k in range(30)] + [(200, None, None), (201, "http://other.example/", "<p>Site slogan</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert len(found) == len(pages)
    assert all(found[k] == f"Body number {k}" for k in range(40))
    assert all(found[100 + k] == "Same copy" for k in range(30))
    assert (found[200], found[201]) == ("", "Site slogan")
    assert html_text.extract(df.limit(0)).count() == 0


def test_templates_with_text_and_blocks():
    parts = ["<div>Contact us <p>Call 555</p></div>", "<section>Related <ul><li>a</li></ul></section>"]
    template = frozenset(html_text.Page("".join(parts)).subtrees)
    assert html_text.main_text(f"<body>{parts[0]}<p>Own</p>{parts[1]}</body>", template) == "Own"


def test_templates_of_small_and_of_mixed_hosts(spark):
    pages = [(k, f"http://small.example/{k}", f"<body><div>Slogan</div><p>Small {k}</p></body>") for k in range(4)]
    # Two sections, each with its own notice; and a sentence quoted in few articles.
    pages += [(100 + k, f"http://mixed.example/{k}", f"<body><div>Notice {k % 2}</div><p>Mixed {k}</p></body>") for k in range(80)]
    pages += [(200 + k, f"http://quotes.example/{k}", f"<article><p>Quoted</p><p>Own {k}</p></article>") for k in range(5)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Small {k}" for k in range(4))
    assert all(found[100 + k] == f"Mixed {k}" for k in range(80))
    assert all(found[200 + k] == f"Quoted\nOwn {k}" for k in range(5))


def test_quality_model(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        w = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        rows.append((k, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((k, int(good)))
    df, lab = spark.createDataFrame([*rows, (999, None), (998, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_model.learn(df, lab.where(quality_model.may_learn()))
    found = {r["doc_id"]: r["score"] for r in quality_model.score(df, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(found[k] >= 0.3) == labels[k][1] for k in held]) > 0.97
    assert 0 <= found[999] == found[998] <= 1
    assert quality_model.accepted(df, model).count() == sum(v >= 0.3 for v in found.values())
    none = quality_model.learn(df, lab.limit(0))
    assert {r["score"] for r in quality_model.score(df, none).collect()} == {0.5}
    assert quality_model.score(df.limit(0), model).count() == 0


def test_word_vectors_come_from_all_texts(spark):
    """Context sums are those of plain loops over all texts, labelled or not; only words below the share have none."""
    q = quality_model
    texts = ["a b, a c", None, "", "x y " * 5, "B!!! b 7x é\n b"] + [" ".join(f"w{k}v{j}" for j in range(50)) for k in range(4)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    cut = [re.findall(r"[^\W_]+|[^\w\s]+", t or "") for t in texts]
    count = Counter(w for c in cut for w in c)
    hash_of = {w: q.tokens(*bytes_of(pa.array([w])))[0][0] for w in count}
    assert len(set(hash_of.values())) == len(count)
    keys = q.common_words(df.select("text"), 100)
    assert set(keys.tolist()) == {int(hash_of[w]) for w, n in count.items() if 100 * n >= count.total()}
    table = q.context_table(df.select("text"), keys)
    for w in ("b", "x"):
        want = np.zeros(q.DIMS)
        for c in cut:
            for k, here in enumerate(c):
                for turn in (-2, -1, 1, 2):
                    if here == w and 0 <= k + turn < len(c):
                        places, signs = q.index_entries(np.array([hash_of[c[k + turn]]]))
                        np.add.at(want, (places[0] + turn) % q.DIMS, signs[0])
        assert np.allclose(table[keys.tolist().index(hash_of[w])], want / np.linalg.norm(want), atol=1e-5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_quality_on_the_tables(spark):
    """Held-out rows: order, decisions and calibration; no input but vectors and the number pooled."""
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality_model.learn(df, labels.where(quality_model.may_learn()))
    held = quality_model.score(df, model).join(labels.where(~quality_model.may_learn()), "doc_id").collect()
    p, y = np.array([r["score"] for r in held]), np.array([r["quality"] for r in held])
    assert (p[y == 1][:, None] > p[y == 0]).mean() > 0.97
    assert ((p >= 0.3) == (y == 1)).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.05


def test_labels_that_disagree_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 0.5, 1), (1, "a b", 0.5, 1), (2, None, 0.1, 0), (None, "x", 0.2, 0)], "doc_id long, text string, score double, _text int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    found = quality_model.score(df, quality_model.learn(df, labels)).collect()
    assert sorted(map(str, (r["doc_id"] for r in found))) == ["1", "1", "2", "None"]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 1}) == 1


def brute_components(rows, percent):
    sets = []
    for key, text in rows:
        w = words_of(text)
        sets.append(frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    return sets, label


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = rows_of(known)
    sets, label = brute_components(rows, percent)
    least = {}
    for (key, _), x in zip(rows, label):
        least[x] = min(key, least.get(x, key))
    want = {key: (len(s), least[x], least[x] == key) for (key, _), s, x in zip(rows, sets, label)}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(known, percent).collect()}
    assert found == want
    assert sum(not k for *_, k in want.values()) > 10
    assert {r["doc_id"] for r in near_dedup.representatives(known, percent).collect()} == {k for k, v in want.items() if v[2]}


def test_near_duplicates_with_repeats_and_null_keys(docs):
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    assert sum(r["doc_id"] is None for r in found) == 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_of_near_copies_lose_no_link(spark):
    """A bucket of many classes in which members are linked in chains, not all with one representative."""
    rng = random.Random(9)
    now, rows = [f"w{k}" for k in range(120)], []
    for k in range(150):
        now = list(now)
        now[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, label = brute_components(rows, 85)
    groups = {}
    for k, x in enumerate(label):
        groups.setdefault(x, set()).add(k)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 85).collect()}
    assert all({found[k] for k in g} == {min(g)} for g in groups.values())
    assert len(set(found.values())) == len(groups)


def test_shingles_across_chunks(monkeypatch):
    import pyarrow as pa

    from tokenloom.llm import shingles

    texts = ["a bb ccc dd e f", None, "", "one", "x" * 50 + " y z A B C", "p q r s t u v w"]
    whole = shingle_sets(*bytes_of(pa.array(texts)))
    monkeypatch.setattr(shingles, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(*bytes_of(pa.array(texts)))))


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"aa": "ka lo mi ne".split(), "bb": "sch ung ver ein".split(), "cc": "ção lhe ndo qui".split()}
    rows = [(k, "".join(rng.choice(parts[lang]) + rng.choice(["", " "]) for _ in range(60)), lang) for k, lang in enumerate(list(parts) * 60)]
    rows += [(900, None, "aa"), (901, "12 !! ", "bb"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.learn(df.where(language_id.may_learn()))
    assert list(known) == ["aa", "bb", "cc"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, known).collect()}
    assert all(found[k][0] == lang for k, _, lang in rows[:180])
    assert {found[k] for k in (900, 901, 902)} == {("und", 0.0)}
    assert {r["lang_pred"] for r in language_id.predict(df, language_id.learn(df.limit(0))).collect()} == {"und"}


def test_a_hot_text_takes_no_place_in_the_sample(spark):
    """Copies of one text, a third of all rows, are one text of the sample; ties, long texts and clashing columns."""
    rng = random.Random(14)
    made = {"de": "sch ung ver ein".split(), "fr": "oux eau ent les".split()}
    rows = [(k, "the one hot text", "en", 0.5, "x") for k in range(300)]
    rows += [(1000 + k, " ".join("".join(rng.choice(made[lang]) for _ in range(3)) for _ in range(30)), lang, 0.5, "x") for k, lang in enumerate(["de", "fr"] * 300)]
    rows += [(2000, "schung " * 100_000, None, 0.5, "x"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    known = language_id.learn(df, sample=601)
    assert list(known) == ["de", "en", "fr"]
    found = language_id.predict(df, known).collect()
    assert len(found) == len(rows)
    assert all(r["lang_pred"] == {**{k: x for k, _, x, *_ in rows}, 2000: "de"}[r["doc_id"]] for r in found if r["doc_id"] is not None)
    assert set(language_id.learn(df, sample=200)) >= {"de", "fr"}
    # Of equal cosines the language that sorts first is taken.
    tied = {k: known["de"] for k in ("x", "y")}
    assert {r["lang_pred"] for r in language_id.predict(df.where("lang = 'de'"), tied).collect()} == {"x"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_languages_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(df.where(~language_id.may_learn()), language_id.learn(df.where(language_id.may_learn())), keep=("doc_id", "lang", "text"))
    rows = [r for r in found.where("lang is not null and length(text) > 40").collect()]
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("string")], ids=["sha256", "clashing"])
def test_exact_dedup(docs, digest):
    rows = rows_of(docs)
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    size, least = Counter(norm), {}
    for (k, _), t in zip(rows, norm):
        least[t] = min((x for x in (k, least.get(t)) if x is not None), default=None)
    want = Counter((k, least[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for (k, _), t in zip(rows, norm))
    found = exact_dedup.exact_dedup(docs, digest=digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(size)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    if digest is exact_dedup.sha256:
        kept = exact_dedup.deduplicated(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len(size)
        assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("string")], ids=["sha256", "clashing"])
def test_batches_against_the_state_of_earlier_ones(spark, tmp_path, digest):
    """What an earlier batch has goes, in several micro-batches too; texts are fetched from the earlier batch's files."""
    first, second = [(5, "a b"), (7, "c"), (8, "c"), (9, None)], [(1, "a  b"), (7, "c"), (10, ""), (11, "new"), (12, "new"), (12, "new"), (13, "other")]
    frames = []
    for k, rows in enumerate((first, second, [])):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / f"b{k}"))
        frames.append(spark.read.parquet(str(tmp_path / f"b{k}")))
    one, two, none = ([tuple(r) for r in exact_dedup.exact_dedup(d, digest=digest, state=str(tmp_path / "state"), max_bytes="1000").select("doc_id", "keep_id", "kept").collect()] for d in frames)
    assert sorted(one) == [(5, 5, True), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert none == []
    assert sorted(k for k, _, kept in two if kept)[-2:] == [12, 13] or sorted(k for k, _, kept in two if kept) == [11, 13]
    if digest is exact_dedup.sha256:
        assert sorted(two) == [(1, 5, False), (7, 7, False), (10, 9, False), (11, 11, True), (12, 11, False), (12, 11, False), (13, 13, True)]


def test_revisits(spark):
    etag = {"ETag": '"1"', "Content-Type": "text/html", "Content-Length": "9", "Expires": "0"}
    rows = [
        (1, "http://www.A.example/p/?b=2&a=1#x", 10, "response", 200, etag, "d1"),
        (2, "https://a.example/p?a=1&b=2&utm_source=z", 20, "revisit", 304, {"etag": 'W/"1"', "Content-Length": "0", "Expires": "7"}, None),
        (3, "a.example/p?a=1&b=2", 30, "response", 404, {}, "d3"),
        (4, "http://a.example:80/p?a=1&b=2", 40, "revisit", 304, {"ETag": '"2"'}, None),
        (5, "http://a.example/p?a=1&b=2", 5, "revisit", 304, {"ETag": '"1"'}, None),
        (6, "http://a.example/q", 50, "revisit", 304, {}, None),
        (7, "http://a.example/p?a=1&b=2", 60, "revisit", 304, {}, None),
        (8, "http://a.example/p?a=1&b=2", 70, "revisit", 304, {}, "d1"),
        (9, None, 1, "response", 200, etag, "d9"),
        (10, None, 2, "revisit", 304, {"ETag": '"1"'}, None),
        (11, "http://a.example/p?a=1&b=2", None, "revisit", 304, None, None),
    ]
    found = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()}
    outcomes = {k: r["outcome"] for k, r in found.items()}
    assert outcomes == {1: "full", 2: "resolved", 3: "full", 4: "mismatch", 5: "orphan", 6: "orphan", 7: "unvalidated", 8: "resolved", 9: "full", 10: "orphan", 11: "orphan"}
    assert (found[2]["refers_to"], found[2]["status"], found[2]["payload_digest"]) == (1, 200, "d1")
    assert found[2]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "content-length": "9", "expires": "7"}
    assert warc.resolve_revisits(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_revisits_of_a_hot_address(spark):
    rng = random.Random(6)
    rows, last, want = [], None, {}
    for k in range(1200):
        if rng.random() < 0.2:
            last = k
            rows.append((k, "http://h/x", k, "response", 200, {"ETag": f"{k}"}, f"d{k}"))
        else:
            rows.append((k, "http://h/x", k, "revisit", 304, {"ETag": f"{last}"}, None))
            want[k] = last
    found = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).where("outcome <> 'full'").collect()
    assert {r["record_id"]: r["refers_to"] for r in found} == want


def test_warc_files(spark, tmp_path):
    import gzip

    def record(kind, url, head, body):
        block = head.encode() + b"\r\n\r\n" + body
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    inner = record("response", "http://in/", "HTTP/1.1 200 OK", b"x") * 2
    parts = [record("warcinfo", "", "", b"i"), record("response", "http://a/", "HTTP/1.1 200 OK\r\nETag: x", b"body WARC/1.0 \xff\x00"), record("revisit", "http://a/", "HTTP/1.1 304 Not Modified", b""), record("response", "http://w/", "HTTP/1.1 200 OK", inner), record("response", "http://z/", "HTTP/1.1 200 OK", b"last")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts)[:-10])
    (tmp_path / "c.warc").write_bytes(b"")
    found = Counter((r["file"][-6:], r["url"], r["kind"], r["status"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect())
    want = [("http://a/", "response", 200, b"body WARC/1.0 \xff\x00"), ("http://a/", "revisit", 304, b""), ("http://w/", "response", 200, inner), ("http://z/", "response", 200, b"last")]
    assert found == Counter([("arc.gz", *w) for w in want] + [("b.warc", *w) for w in want[:-1]])


def test_many_members_are_read_in_time(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 1000
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "m.warc.gz").write_bytes(gzip.compress(one) * 30_000)
    assert warc.read_warc(spark, str(tmp_path)).count() == 30_000


def test_no_record_is_lost_between_buffers(spark, tmp_path):
    """Records of all lengths and without payload, so that their borders meet those of the reader's buffers in every way."""
    pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/WARC/1.0/"), "id").alias("url"), F.repeat(F.lit("x\r\n"), (F.col("id") % 40).cast("int")).alias("html"))
    rows = warc.records(pages)
    warc.write_warc(rows, str(tmp_path / "gz"))
    rows.write.option("lineSep", "\r\n\r\n").text(str(tmp_path / "plain"))
    want = rows.count()
    for name in ("gz", "plain"):
        found = warc.captures(warc.read_warc(spark, str(tmp_path / name))).agg(F.count(F.lit(1)), F.count_distinct("record_id"), F.sum("payload_bytes")).first()
        assert tuple(found) == (want, want, sum(3 * (k % 40) for k in range(40_000)))


def test_revisits_of_one_moment_have_their_payload(spark, tmp_path):
    """A hot address whose captures share one time, written as WARC, read and resolved; payloads of what revisits refer to."""
    pages = spark.createDataFrame([(k, "http://h/x", f"<p>{k % 3}") for k in range(900)] + [(None, None, None), (5000, "http://o/", None)], "page_id long, url string, html string")
    warc.write_warc(warc.records(pages), str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    found = warc.captures(read).withColumn("ts", F.when(F.col("kind") == "revisit", 1).otherwise(0).cast("long"))
    done = warc.resolve_revisits(found)
    rows = {r["record_id"]: r for r in done.where("record_id is not null").collect()}
    revisits = [r for r in rows.values() if r["outcome"] in ("resolved", "mismatch")]
    # All responses come before all revisits: each is held against the last response.
    assert {r["refers_to"] for r in revisits if r["outcome"] == "resolved" and r["record_id"] < 5000} == {899 * 4}
    payloads = warc.with_payload(done, read.select(F.regexp_extract("record", r"(\d+)", 1).try_cast("long").alias("record_id"), "payload")).where("outcome = 'resolved'").collect()
    assert payloads and all(bytes(r["payload"]) == (f"<p>{899 % 3}".encode() if r["record_id"] < 5000 else b"") for r in payloads)
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] and r["payload_bytes"] == len(r["payload"]) for r in payloads)


def test_revisits_with_clashing_columns_and_repeats(spark):
    rows = [(1, "http://a/", 1, "response", 200, {"ETag": "x"}, "d", "c1", 1), (2, "http://a/", 2, "revisit", 304, {"ETag": "x"}, None, "c2", 2)] * 2
    df = spark.createDataFrame(rows, warc.RECORD + ", canonical string, piece int")
    found = warc.resolve_revisits(df).collect()
    assert Counter((r["record_id"], r["outcome"], r["refers_to"]) for r in found) == {(1, "full", None): 2, (2, "resolved", 1): 2}


def measured(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup, windows = set(), 0, Counter(zip(w, w[1:], w[2:]))
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@pytest.mark.parametrize("bits", [21, 4], ids=["packed", "exact"])
def test_quality_rules(docs, monkeypatch, bits):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", bits)
    monkeypatch.setattr(quality_rules, "MOST_WORDS", 1 << bits)
    held = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    found = quality_rules.apply_policy(quality_rules.ledger(docs, keep=("doc_id", "text"))).collect()
    assert len(found) == held.count()
    for r in found:
        want = measured(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_policies_and_ablations(docs):
    book = stored(quality_rules.ledger(docs), "ledger")
    masks = [r["fail_mask"] for r in book.collect()]
    policy = quality_rules.POLICIES["v1"]
    for r in quality_rules.ablations(book).collect():
        bit = 1 << r["bit"]
        assert r["n_failed"] == sum(m & bit > 0 for m in masks)
        assert r["n_failed_alone"] == sum(m & policy == bit for m in masks)
        assert r["n_kept_without"] == sum(m & policy & ~bit == 0 for m in masks)
    assert quality_rules.accepted(docs).columns == docs.columns
    assert quality_rules.accepted(docs).count() == sum(m & policy == 0 for m in masks)


def test_context_mixing(docs):
    train = docs.where(context_mixing.may_learn())
    counts = stored(context_mixing.corpus_counts(train), "counts")
    mixer = context_mixing.learn(counts)
    found = context_mixing.score(docs, counts, mixer).collect()
    c = Counter()
    for key, text in rows_of(docs):
        if zlib.crc32(("" if key is None else str(key)).encode()) % 7 != 2:
            c.update([*words_of(text), None])
    n, v = sum(c.values()), len(c)
    want = []
    for key, text in rows_of(docs):
        t = [*words_of(text), None]
        want.append((key if key is not None else -1, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found]
    assert sorted(got) == sorted(want)
    assert all(r["train_tokens"] == n and r["score"] < 0 and r["bits_per_byte"] > 0 for r in found)
    # A score is the sum over the text's windows, each as the mixer has it (which is tested against plain counts below).
    score_of = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in found}
    for key, text in rows_of(docs)[::9]:
        keys, _ = context_mixing.windows(*bytes_of(pa.array([text or ""])))
        t = [*words_of(text), None]
        base = round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)
        assert abs(score_of[key, len(t), base] - mixer.log10(keys).sum()) < 1e-3 * len(keys)


def test_scores_are_the_same_from_a_table(docs, tmp_path):
    """Rows of a Parquet table are numbered by their place in it, others once they are stored."""
    docs.write.parquet(str(tmp_path / "d"))
    counts = stored(context_mixing.corpus_counts(docs), "counts")
    mixer = context_mixing.learn(counts)
    one, two = (sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in context_mixing.score(d, counts, mixer).collect()) for d in (docs, docs.sparkSession.read.parquet(str(tmp_path / "d"))))
    assert one == two
    none = stored(context_mixing.corpus_counts(docs.limit(0)), "counts")
    found = context_mixing.score(docs, none, context_mixing.learn(none)).collect()
    assert len(found) == docs.count()
    assert all(abs(r["bits_per_byte"] - 8) < 0.01 and r["n_known"] == 0 for r in found)
    assert context_mixing.score(docs.limit(0), counts, mixer).count() == 0


def test_mixer_is_a_distribution(docs):
    """In any context the probabilities of all 256 bytes sum to one."""
    mixer = context_mixing.learn(stored(context_mixing.corpus_counts(docs), "counts"))
    for context in (b"\0\0\0\0\0", b"the a", b"zzzzz"):
        key = int.from_bytes(context + b"\0", "big")
        p = 10 ** mixer.log10(np.arange(256, dtype=np.uint64) | np.uint64(key))
        assert abs(p.sum() - 1) < 1e-4


def test_each_context_has_counts_of_its_own(spark):
    """Scores agree with plain counts of all windows, so no two contexts share any, however many there are."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcde \n") for _ in range(60)) for _ in range(40)] + ["a", "", " b"]
    held = context_mixing.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    more = spark.range(600_000).select(F.lit(1).cast("byte").alias("kind"), F.xxhash64("id").bitwiseAND(F.lit((1 << 48) - 1)).alias("key"), F.lit(1).cast("long").alias("n"))
    counts = stored(held.unionByName(more).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    mixer = context_mixing.learn(counts)
    found = counts.where("kind = 1").toArrow()
    keys, n = np.asarray(found["key"].combine_chunks()).astype(np.uint64), np.asarray(found["n"].combine_chunks())
    apart = [0, 32, *range(9, 14)]
    inside = np.cumprod([~np.isin((keys >> np.uint64(8 * k)) & np.uint64(255), apart) for k in range(1, 6)], axis=0).sum(axis=0)

    def seen(w, order):
        """Zeros and ones of each bit of w's byte in its context of this order."""
        if order == 0:
            word = next((k for k in range(5) if w[4 - k] in apart), 5)
            rows, mask = inside == word, (1 << (8 * word)) - 1
        else:
            rows, mask = True, (1 << (8 * order)) - 1
        rows = np.flatnonzero(rows & ((keys >> np.uint64(8)) & np.uint64(mask) == int.from_bytes(w[:5], "big") & mask))
        byte, times = (keys[rows] & np.uint64(255)).astype(int), n[rows]
        return [tuple(times[(byte >> (7 - p)) == (w[5] >> (8 - p)) * 2 + bit].sum() for bit in (0, 1)) for p in range(8)]

    asked = [int(k).to_bytes(6, "big") for k in np.sort(keys)[:: len(keys) // 25]] + [b"zzzzza", b"abcde\xff", b"\0\0\0\0\0z", b"a bcda", b"cde ab"]
    want = []
    for w in asked:
        total, each = 0, [seen(w, order) for order in range(6)]
        for p in range(8):
            bit, pairs = (w[5] >> (7 - p)) & 1, [e[p] for e in each]
            gate = max(sum(a + b >= 2 for a, b in pairs) - 1, 0)
            s = sum(x * math.log((b + 0.4) / (a + 0.4)) for x, (a, b) in zip(mixer.weights[p, gate], pairs))
            one = 0.5 * (1 / (1 + math.exp(-s)) + mixer.refine[(w[5] >> (8 - p)) | (1 << p), context_mixing.bins(np.array([s]))[0]])
            total += math.log10(one if bit else 1 - one)
        want.append(total)
    assert np.allclose(mixer.log10(np.array([int.from_bytes(w, "big") for w in asked], np.uint64)), want, atol=1e-3)


def test_mixer_learns_from_every_window_as_often_as_it_occurs(spark):
    """The refinement holds every occurrence: the bits that follow no others, whose node all windows share, add up."""
    times = {b"the caX": 50_000, b"the caY": 7}
    rows = [(1, int.from_bytes(w[1:], "big"), n) for w, n in times.items()]
    many = spark.range(300_000).select(F.lit(1).cast("byte").alias("kind"), (F.col("id") * 65536 + 0x20000000000 + F.col("id") % 2 * 255).alias("key"), F.lit(1).cast("long").alias("n"))
    counts = stored(spark.createDataFrame(rows, "kind byte, key long, n long").unionByName(many), "counts")
    seen = []
    whole = context_mixing.summed

    def watched(rows, tasks, size, measure):
        seen.append(whole(rows, tasks, size, measure))
        return seen[-1]

    context_mixing.summed = watched
    try:
        context_mixing.learn(counts)
    finally:
        context_mixing.summed = whole
    n, ones = seen[-1].reshape(2, 256, -1)[:, 1].sum(axis=1)
    assert (n, ones) == (350_007, 150_000)


def test_windows_are_those_of_the_text():
    data, offsets = np.frombuffer(b"aBcde", np.uint8), np.array([0, 2, 2, 5])
    keys, ends = context_mixing.windows(data, offsets)
    text = [(b"\0\0\0\0\0ab\xff"), b"\0\0\0\0\0\xff", b"\0\0\0\0\0cde\xff"]
    want = [int.from_bytes(t[k : k + 6], "big") for t in text for k in range(len(t) - 5)]
    assert keys.tolist() == want
    assert ends.tolist() == [3, 4, 8]


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == label
    assert len(found) == len(label)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_join(spark):
    many = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(1000)] + [(None, -1)], "g int, k int")
    few = spark.createDataFrame([(k, f"v{k}") for k in range(0, 900)], "g int, v string")
    for how in ("inner", "left"):
        a = sorted(map(tuple, salted_join(many, few, ["g"], how, seed="k").select("g", "k", "v").collect()), key=str)
        b = sorted(map(tuple, many.join(few, "g", how).select("g", "k", "v").collect()), key=str)
        assert a == b


def test_split_of_identifiers(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 1, 77, -5)] + [(None,)], "doc_id long").select("doc_id", bucket_of("doc_id", 7).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 for r in rows)
