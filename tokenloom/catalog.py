"""The registered queries of the engine's own operators and their DuckDB equivalents."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import columns as c
from tokenloom.operators import encode as e
from tokenloom.plans import tree
from tokenloom.sources import files
from tokenloom.streaming import decode, refresh

FLAGSHIP = "count_tokens_by_document"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Words the small vocabularies of the queries hold.
WORDS = "the of and to in that is for it was der die und das la de el que les et".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_level(pre: str = "WhitespaceSplit", **parts) -> str:
    model = {"type": "WordLevel", "vocab": {w: i for i, w in enumerate(["<unk>", *WORDS])}, "unk_token": "<unk>"}
    return json.dumps({"version": "1.0", "pre_tokenizer": {"type": pre}, "model": model} | parts)


def byte_level() -> str:
    """Byte-level BPE with the merges of the small words, in order."""
    from tokenloom.functions.unicode import GLYPHS

    vocab, merges = {g: i for i, g in enumerate(GLYPHS)}, []
    for w in WORDS:
        made = "Ġ"
        for ch in w:
            if made + ch not in vocab and len(ch.encode()) == 1:
                vocab[made + ch] = len(vocab)
                merges.append(f"{made} {ch}")
            made += ch
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return json.dumps({"version": "1.0", "pre_tokenizer": level, "post_processor": level, "decoder": level, "model": {"type": "BPE", "vocab": vocab, "merges": merges}})


SPLIT_WS = r"regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D \x85\x{A0}]+')"
PIECES = "SELECT doc_id, {0} AS p FROM documents"
SUMMARY = "SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pieces, md5(array_to_string(p, chr(1))) AS digest FROM (" + PIECES + ")"


def summary(df: DataFrame, pieces) -> DataFrame:
    return df.select("doc_id", pieces.alias("p")).select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\x01")).alias("digest"))


def text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


@query(f"SELECT doc_id, CAST(len(p) AS INTEGER) AS n_tokens FROM ({PIECES.format(SPLIT_WS)})")
def count_tokens_by_document(spark, sf_dir):
    return e.count_tokens(load(spark, sf_dir), word_level())


@query(f"SELECT lang, source, count(*) AS n_docs, CAST(sum(len(p)) AS BIGINT) AS n_tokens FROM (SELECT lang, source, {SPLIT_WS} AS p FROM documents) GROUP BY lang, source")
def count_tokens_by_source(spark, sf_dir):
    found = e.count_tokens(load(spark, sf_dir), word_level(), keep=("lang", "source"))
    return found.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({SPLIT_WS}) AS w FROM documents) GROUP BY w")
def distinct_words(spark, sf_dir):
    return load(spark, sf_dir).select(F.explode(c.whitespace_split(text())).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN v.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unk, CAST(sum(coalesce(v.id, 0)) AS BIGINT) AS id_sum FROM "
    f"(SELECT doc_id, unnest({SPLIT_WS}) AS w FROM documents) LEFT JOIN (VALUES {', '.join(f'({chr(39)}{w}{chr(39)}, {k + 1})' for k, w in enumerate(WORDS))}) v(word, id) ON w = v.word GROUP BY doc_id"
)
def word_level_ids(spark, sf_dir):
    vocab = spark.createDataFrame([(w, k + 1) for k, w in enumerate(WORDS)], "word string, id int")
    rows = e.word_level_ids(load(spark, sf_dir), c.whitespace_split, vocab, 0)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == 0).alias("n_unk"), F.sum("id").cast("long").alias("id_sum"))


@query(SUMMARY.format(r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x09-\x0D \x85\x{A0}]+')"))
def pieces_whitespace(spark, sf_dir):
    return summary(load(spark, sf_dir), c.whitespace(text()))


@query(SUMMARY.format(r"regexp_extract_all(coalesce(text, ''), '[!-/:-@\[-`{-~\p{P}]|[^!-/:-@\[-`{-~\p{P}]+')"))
def pieces_punctuation(spark, sf_dir):
    return summary(load(spark, sf_dir), c.punctuation(text()))


@query(SUMMARY.format(r"regexp_extract_all(coalesce(text, ''), '\p{N}+|\P{N}+')"))
def pieces_digits(spark, sf_dir):
    return summary(load(spark, sf_dir), c.digits(text()))


@query(SUMMARY.format(r"regexp_extract_all(coalesce(text, ''), '\p{N}|\P{N}+')"))
def pieces_single_digits(spark, sf_dir):
    return summary(load(spark, sf_dir), c.digits(text(), True))


@query(SUMMARY.format(r"list_filter(string_split(coalesce(text, ''), ','), lambda x: x <> '')"))
def pieces_delimiter(spark, sf_dir):
    return summary(load(spark, sf_dir), c.delimiter(text(), ","))


@query(SUMMARY.format(r"regexp_extract_all(coalesce(text, ''), '(?s:.{1,5})')"))
def pieces_fixed_length(spark, sf_dir):
    return summary(load(spark, sf_dir), c.fixed_length(text(), 5))


SPLITS = {"removed": r"[^-]+", "isolated": r"-|[^-]+", "contiguous": r"-+|[^-]+", "merged_with_previous": r"[^-]+-?|-", "merged_with_next": r"-?[^-]+|-"}


def split_query(name: str, regex: str) -> None:
    def run(spark, sf_dir):
        return summary(load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")), c.split(text(), "-", name))

    run.__name__ = f"split_{name}"
    query(f"SELECT page_id AS doc_id, CAST(len(p) AS INTEGER) AS n_pieces, md5(array_to_string(p, chr(1))) AS digest FROM (SELECT page_id, regexp_extract_all(coalesce(url, ''), '{regex}') AS p FROM pages)")(run)


for _name, _regex in SPLITS.items():
    split_query(_name, _regex)


@query(SUMMARY.format(r"regexp_extract_all(CASE WHEN coalesce(text, '') = '' OR starts_with(text, ' ') THEN replace(coalesce(text, ''), ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END, '▁?[^▁]+|▁')"))
def pieces_metaspace(spark, sf_dir):
    return summary(load(spark, sf_dir), c.metaspace(text()))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '^[\x09-\x0D ]+', ''), '[\x09-\x0D ]+$', '')) AS stripped, md5(replace(coalesce(text, ''), 'the', 'THE')) AS replaced, md5(CASE WHEN coalesce(text, '') = '' THEN '' ELSE '▁' || text END) AS prepended, md5(regexp_replace(coalesce(text, ''), '[\x09\x0A\x0C\x0D]', ' ', 'g')) AS nmt FROM documents")
def normalized_texts(spark, sf_dir):
    t = text()
    return load(spark, sf_dir).select("doc_id", F.md5(c.strip(t)).alias("stripped"), F.md5(c.replace_all(t, "the", "THE")).alias("replaced"), F.md5(c.prepend(t, "▁")).alias("prepended"), F.md5(c.nmt(t)).alias("nmt"))


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS INTEGER) AS n_glyphs, md5(coalesce(text, '')) AS back FROM documents")
def byte_glyphs(spark, sf_dir):
    """Every byte is one glyph, and the glyphs give the text back."""
    g = load(spark, sf_dir).select("doc_id", c.to_glyphs(text()).alias("g"))
    return g.select("doc_id", F.length("g").alias("n_glyphs"), F.md5(c.from_glyphs(F.col("g"))).alias("back"))


@query(r"SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pieces, CAST(coalesce(list_sum(list_transform(p, lambda x: strlen(x))), 0) AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '\p{N}+|\P{N}+') END AS p FROM documents)")
def piece_offsets(spark, sf_dir):
    rows = load(spark, sf_dir).select("doc_id", c.digits(text()).alias("p"))
    rows = rows.select("doc_id", "p", F.aggregate("p", F.lit(0), lambda a, x: a + F.octet_length(x)).alias("end"))
    return rows.select("doc_id", F.size("p").alias("n_pieces"), F.col("end").cast("long").alias("n_bytes"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("n_chars"))


@query(
    "SELECT doc_id, CAST(k AS INTEGER) AS part_no, CAST(least(64, n - k * 48) AS INTEGER) AS n_tokens FROM "
    f"(SELECT doc_id, len(p) AS n, unnest(range(0, greatest(1, CAST(ceil((len(p) - 16) / 48.0) AS BIGINT)))) AS k FROM ({PIECES.format(SPLIT_WS)}))"
)
def strided_parts(spark, sf_dir):
    words = load(spark, sf_dir).select("doc_id", c.whitespace_split(text()).alias("w"))
    rows = words.select("doc_id", F.posexplode(c.chunks(F.col("w"), 64, 16)).alias("part_no", "part"))
    return rows.select("doc_id", "part_no", F.size("part").alias("n_tokens"))


TURNS = r"(SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D \x85\x{A0}]+')) AS n FROM conversations)"


@query(f"SELECT conv_id, turn, CAST(n AS INTEGER) AS n_tokens, CAST(ceil(max(n) OVER (PARTITION BY conv_id) / 8.0) * 8 AS INTEGER) AS n_padded, CAST(ceil(max(n) OVER (PARTITION BY conv_id) / 8.0) * 8 - n AS INTEGER) AS n_pad FROM {TURNS}")
def padded_batches(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(c.whitespace_split(text()), lambda x: F.lit(1)).alias("ids"))
    longest = rows.groupBy("conv_id").agg(F.max(F.size("ids")).alias("n"))
    to = (F.ceil(F.col("n") / 8) * 8).cast("int")
    out = rows.join(longest, "conv_id").select("conv_id", "turn", F.size("ids").alias("n_tokens"), c.padded(F.col("ids"), to, F.lit(0)).alias("p"))
    return out.select("conv_id", "turn", "n_tokens", F.size("p").alias("n_padded"), F.size(F.filter("p", lambda x: x == 0)).alias("n_pad"))


@query(f"SELECT a.conv_id, a.turn, CAST(a.n + b.n + 3 AS INTEGER) AS n_ids, CAST(b.n + 1 AS INTEGER) AS n_second FROM {TURNS} a JOIN {TURNS} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def templated_pairs(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    special = {t: {"id": t, "ids": [i], "tokens": [t]} for t, i in (("[CLS]", 1), ("[SEP]", 2))}
    from tokenloom.functions.encoding import template_pieces

    post = {"type": "TemplateProcessing", "single": template_pieces("[CLS] $A [SEP]"), "pair": template_pieces("[CLS] $A [SEP] $B:1 [SEP]:1"), "special_tokens": special}
    found = e.encode(rows.join(after, ["conv_id", "turn"]), word_level(post_processor=post), keep=("conv_id", "turn"), pair="reply", unit="none", want=("ids", "type_ids"))
    return found.select("conv_id", "turn", F.size("ids").alias("n_ids"), F.aggregate("type_ids", F.lit(0), lambda a, x: a + x).alias("n_second"))


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role GROUP BY conv_id")
def ctc_roles(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", F.array_join(c.ctc_decoded(F.transform("t", lambda x: x["role"]), clean=False), " ").alias("roles"))


def url_files(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    return rows.select(F.concat(path, F.lit("/"), F.col("page_id").cast("string")).alias("rel_path"), F.size(c.whitespace_split(F.coalesce("html", F.lit("")))).alias("token_count"), F.octet_length(F.coalesce("html", F.lit(""))).alias("length"))


URL_FILES = r"SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/' || CAST(page_id AS VARCHAR), '/'), lambda x: x <> '') AS s, len(regexp_extract_all(coalesce(html, ''), '[^\x09-\x0D \x85\x{A0}]+')) AS t, strlen(coalesce(html, '')) AS l FROM pages"
TREE = f"SELECT path, CAST(depth AS INTEGER) AS depth, is_dir, CAST(sum(t) AS BIGINT) AS token_count, count(*) AS file_count, CAST(sum(l) AS BIGINT) AS file_size FROM (SELECT array_to_string(list_slice(s, 1, d), '/') AS path, d AS depth, d < len(s) AS is_dir, t, l FROM (SELECT s, t, l, unnest(range(0, len(s) + 1)) AS d FROM ({URL_FILES}))) GROUP BY path, depth, is_dir"


@query(TREE)
def tree_roll_up(spark, sf_dir):
    return tree.roll_up(url_files(spark, sf_dir)).select("path", "depth", "is_dir", "token_count", "file_count", "file_size")


@query(f"WITH tree AS ({TREE}), hits AS (SELECT path FROM tree WHERE depth > 0 AND contains(lower(regexp_extract(path, '[^/]*$')), 'blog')) SELECT * FROM tree t WHERE EXISTS (SELECT 1 FROM hits h WHERE h.path = t.path OR starts_with(t.path, h.path || '/') OR starts_with(h.path, t.path || '/') OR t.path = '')")
def tree_search(spark, sf_dir):
    return tree.search(tree.roll_up(url_files(spark, sf_dir)), "BLOG").select("path", "depth", "is_dir", "token_count", "file_count", "file_size")


@query(f"SELECT array_to_string(s, '/') AS path, l > 4000 OR list_contains(list_transform(list_slice(s, 1, len(s) - 1), lambda x: lower(x)), 'de') AS skipped FROM ({URL_FILES})")
def file_filter(spark, sf_dir):
    rows = url_files(spark, sf_dir)
    return rows.select(F.array_join(tree.segments(F.col("rel_path")), "/").alias("path"), tree.skip_file(F.col("rel_path"), F.col("length"), ("DE",), 4000).alias("skipped"))


@query("WITH e AS (SELECT user_id, event_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, event_type AS rel_path, max(event_id) AS seq, count(*) AS n_events FROM s GROUP BY user_id, event_type, n")
def change_sessions(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(refresh.timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("rel_path"))
    at = F.session_window("ts", "1 hour")
    return rows.groupBy(at, "user_id", "rel_path").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_events")).select("user_id", "rel_path", "seq", "n_events")


@query(r"SELECT doc_id, CAST(len(string_split(coalesce(text, ''), 'the')) - 1 AS INTEGER) AS n_added FROM documents")
def added_tokens(spark, sf_dir):
    """Occurrences of an added token anywhere in the text."""
    config = json.loads(word_level(pre="WhitespaceSplit")) | {"added_tokens": [{"id": 0, "content": "the", "special": True, "normalized": False}]}
    found = e.encode(load(spark, sf_dir), json.dumps(config), unit="none", want=("ids",))
    return found.select("doc_id", F.size(F.filter("ids", lambda x: x == 1)).alias("n_added"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS decoded_md5 FROM documents")
def byte_level_round_trip(spark, sf_dir):
    config = byte_level()
    coded = e.encode(load(spark, sf_dir), config, unit="none", want=("ids",)).select("doc_id", "ids")
    return e.decode(coded, config).select("doc_id", F.md5("decoded").alias("decoded_md5"))


@query()
def byte_level_spans(spark, sf_dir):
    """Spans of all tokens; tested against the kernels on small texts, for SQL has no such merges."""
    return e.spans(load(spark, sf_dir), byte_level())


@query(f"SELECT doc_id, CAST(len(p) AS INTEGER) AS n_words FROM (SELECT doc_id, {SPLIT_WS} AS p FROM documents)")
def words_of_encodings(spark, sf_dir):
    found = e.encode(load(spark, sf_dir), word_level(), want=("words",))
    return found.select("doc_id", F.size("words").alias("n_words"))


@query(r"SELECT doc_id, CAST(k - 1 AS INTEGER) AS line_no, md5(l[k]) AS line, CAST(coalesce(list_sum(list_transform(list_slice(l, 1, k - 1), lambda x: length(x) + 1)), 0) AS INTEGER) AS start FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))")
def text_lines(spark, sf_dir):
    return e.lines(load(spark, sf_dir)).select("doc_id", "line_no", F.md5("line").alias("line"), "start")


def merging() -> str:
    """Byte-level BPE with two merges, o n and then on e."""
    config = json.loads(byte_level())
    from tokenloom.functions.unicode import GLYPHS

    config["model"] |= {"vocab": {g: i for i, g in enumerate([*GLYPHS, "on", "one"])}, "merges": ["o n", "on e"]}
    return json.dumps(config)


@query(r"SELECT doc_id, CAST(strlen(t) - len(string_split(t, 'on')) - len(string_split(t, 'one')) + 2 AS INTEGER) AS n_tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def bpe_counts(spark, sf_dir):
    """Byte-level BPE tokens, counted without laying out ids."""
    return e.count_tokens(load(spark, sf_dir), merging())


@query(r"SELECT doc_id, CAST(len(string_split(t, 'on')) - len(string_split(t, 'one')) AS INTEGER) AS n_on, CAST(len(string_split(t, 'one')) - 1 AS INTEGER) AS n_one, CAST(strlen(t) - 2 * (len(string_split(t, 'on')) - 1) - (len(string_split(t, 'one')) - 1) AS INTEGER) AS n_bytes FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def bpe_ids(spark, sf_dir):
    ids = e.encode(load(spark, sf_dir), merging(), unit="none", want=("ids",)).select("doc_id", "ids")
    return ids.select("doc_id", *[F.size(F.filter("ids", test)).alias(n) for n, test in (("n_on", lambda x: x == 256), ("n_one", lambda x: x == 257), ("n_bytes", lambda x: x < 256))])


def public_tokenizer(name: str) -> str | None:
    """The path of a public tokenizer's file: in the folder TOKENLOOM_TOKENIZERS, else where the installed package has it; None without either."""
    folder = os.environ.get("TOKENLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return None
    return public_tokenizers.path(name)


def count_bpe_tokens(spark, sf_dir):
    """Tokens of every document under a byte-level vocabulary of 50,000; tested against the tokenizers library."""
    with open(public_tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        return e.count_tokens(load(spark, sf_dir), f.read())


if public_tokenizer("byte_bpe_50k.json"):
    query()(count_bpe_tokens)


def normalizing(name: str, config: dict, sql: str) -> None:
    def run(spark, sf_dir):
        return e.normalized(load(spark, sf_dir), config).select("doc_id", F.md5("normalized").alias("normalized_md5"))

    run.__name__ = name
    query(f"SELECT doc_id, md5({sql}) AS normalized_md5 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")(run)


normalizing("nfc_texts", {"type": "NFC"}, "nfc_normalize(t)")
normalizing("nfd_then_nfc_texts", {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "NFC"}]}, "nfc_normalize(t)")
normalizing("lowercased_texts", {"type": "Lowercase"}, "lower(t)")
normalizing("accentless_texts", {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "StripAccents"}]}, "strip_accents(t)")
normalizing("bert_texts", {"type": "BertNormalizer"}, r"lower(strip_accents(regexp_replace(t, '[\t\n\r]', ' ', 'g')))")


def cutting(name: str, config: dict, sql: str) -> None:
    def run(spark, sf_dir):
        return summary(e.words_of(load(spark, sf_dir), config), F.col("words"))

    run.__name__ = name
    query(SUMMARY.format(sql))(run)


_MARK, _SPACE = r"!-/:-@\[-`{-~\p{P}", r"\x09-\x0D \x85\x{A0}"
cutting("bert_words", {"type": "BertPreTokenizer"}, "regexp_extract_all(coalesce(text, ''), '[" + _MARK + "]|[^" + _MARK + _SPACE + "]+')")
cutting("words_then_digits", {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": True}]}, r"regexp_extract_all(coalesce(text, ''), '\p{N}|[^\p{N}" + _SPACE + "]+')")
cutting("letter_runs", {"type": "Split", "pattern": {"Regex": r"\p{L}+"}, "behavior": "Isolated", "invert": False}, r"regexp_extract_all(coalesce(text, ''), '\p{L}+|[^\p{L}]+')")


LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Texts of lower-case letters and single spaces, on which models with a vocabulary of letters can be told by SQL.
PLAIN_SQL = r"trim(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g'))"


def plain(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir).select("doc_id", F.trim(F.regexp_replace(text(), "[^a-z]+", " ")).alias("text"))


def word_piece() -> str:
    vocab = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", *LETTERS, *("##" + x for x in LETTERS), "th", "##th"])}
    model = {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": vocab}
    return json.dumps({"normalizer": {"type": "BertNormalizer"}, "pre_tokenizer": {"type": "BertPreTokenizer"}, "model": model, "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": False}})


@query(f"SELECT doc_id, CAST(length(replace(t, ' ', '')) - len(string_split(t, 'th')) + 1 AS INTEGER) AS n_tokens FROM (SELECT doc_id, {PLAIN_SQL} AS t FROM documents)")
def word_piece_counts(spark, sf_dir):
    """Greedy longest match: a letter each, but th is one; no word of the tables has over 100 letters."""
    return e.count_tokens(plain(spark, sf_dir), word_piece())


def unigram() -> str:
    vocab = [["<unk>", 0.0], *([x, -1.0] for x in "▁" + LETTERS), ["th", -1.5], ["he", -1.9]]
    space = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}
    return json.dumps({"pre_tokenizer": space, "decoder": space, "model": {"type": "Unigram", "unk_id": 0, "vocab": vocab}})


@query(f"SELECT doc_id, CAST(length(t) + (t <> '')::int - len(string_split(t, 'th')) + 1 - (len(string_split(replace(t, 'th', '#'), 'he')) - 1) AS INTEGER) AS n_tokens FROM (SELECT doc_id, {PLAIN_SQL} AS t FROM documents)")
def unigram_counts(spark, sf_dir):
    """The most probable pieces: th before he where they share the h."""
    return e.count_tokens(plain(spark, sf_dir), unigram())


def suffixed() -> str:
    vocab = {t: i for i, t in enumerate([*LETTERS, *(x + "</w>" for x in LETTERS), "th", "the</w>"])}
    model = {"type": "BPE", "vocab": vocab, "merges": ["t h", "th e</w>"], "end_of_word_suffix": "</w>"}
    return json.dumps({"pre_tokenizer": {"type": "WhitespaceSplit"}, "model": model, "decoder": {"type": "BPEDecoder", "suffix": "</w>"}})


def falling_back() -> str:
    vocab = {f"<0x{b:02X}>": b for b in range(256)} | {x: 256 + k for k, x in enumerate(LETTERS)}
    model = {"type": "BPE", "vocab": vocab, "merges": [], "byte_fallback": True}
    return json.dumps({"model": model, "decoder": {"type": "Sequence", "decoders": [{"type": "ByteFallback"}, {"type": "Fuse"}]}})


def round_trip(name: str, config, source, sql: str) -> None:
    def run(spark, sf_dir):
        held = config()
        coded = e.encode(source(spark, sf_dir), held, unit="none", want=("ids",)).select("doc_id", "ids")
        return e.decode(coded, held).select("doc_id", F.md5("decoded").alias("decoded_md5"))

    run.__name__ = name
    query(f"SELECT doc_id, md5({sql}) AS decoded_md5 FROM documents")(run)


round_trip("word_piece_round_trip", word_piece, plain, PLAIN_SQL)
round_trip("unigram_round_trip", unigram, plain, PLAIN_SQL)
round_trip("suffix_round_trip", suffixed, plain, PLAIN_SQL)
round_trip("byte_fallback_round_trip", falling_back, load, "coalesce(text, '')")


def processed_pairs(name: str, post: dict, sql: str, second: str) -> None:
    """Pairs of turns under a post-processor: all ids and all type ids in turn."""

    def run(spark, sf_dir):
        rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
        after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
        found = e.encode(rows.join(after, ["conv_id", "turn"]), word_level(post_processor=post), keep=("conv_id", "turn"), pair="reply", unit="none", want=("ids", "type_ids"))
        return found.select("conv_id", "turn", F.array_join("ids", ",").alias("ids"), F.array_join("type_ids", "").alias("type_ids"))

    run.__name__ = name
    words = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[^\x09-\x0D \x85\x{{A0}}]+'), lambda w: coalesce(list_position([{1}], w), 0))"
    known = ", ".join(f"'{w}'" for w in WORDS)
    a, b = words.format("a.text", known), words.format("b.text", known)
    query(
        f"SELECT conv_id, turn, array_to_string({sql}, ',') AS ids, {second} AS type_ids FROM "
        f"(SELECT a.conv_id, a.turn, {a} AS x, {b} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
    )(run)


processed_pairs(
    "bert_pairs", {"type": "BertProcessing", "sep": ["[SEP]", 102], "cls": ["[CLS]", 101]},
    "list_concat([101], list_concat(list_concat(x, [102]), list_concat(y, [102])))", "repeat('0', len(x) + 2) || repeat('1', len(y) + 1)",
)
processed_pairs(
    "roberta_pairs", {"type": "RobertaProcessing", "sep": ["</s>", 2000], "cls": ["<s>", 1000], "trim_offsets": True, "add_prefix_space": False},
    "list_concat([1000], list_concat(list_concat(x, [2000, 2000]), list_concat(y, [2000])))", "repeat('0', len(x) + len(y) + 4)",
)


@query(r"SELECT doc_id, md5(coalesce(string_agg((e - strlen(x))::varchar || '-' || e::varchar, ',' ORDER BY k), '')) AS spans FROM (SELECT doc_id, k, x, sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '\p{N}+|\P{N}+') AS p FROM documents WHERE text <> ''))) GROUP BY doc_id UNION ALL SELECT doc_id, md5('') FROM documents WHERE coalesce(text, '') = ''")
def running_offsets(spark, sf_dir):
    """Byte offsets of all pieces."""
    spans = F.transform(c.running_bytes(c.digits(text())), lambda s: F.concat_ws("-", s["start"], s["end"]))
    return load(spark, sf_dir).select("doc_id", F.md5(F.array_join(spans, ",")).alias("spans"))


@query(r"SELECT conv_id, turn, md5(coalesce(text, '')) AS decoded_md5 FROM conversations WHERE text <> ''")
def streamed_decoding(spark, sf_dir):
    """Ids of each turn one by one: what the stream decoder gives out makes up the text."""
    config = byte_level()
    ids = e.encode(load(spark, sf_dir, "conversations"), config, keep=("conv_id", "turn"), unit="none", want=("ids",))
    rows = ids.select(F.xxhash64("conv_id", "turn").alias("stream_id"), "conv_id", "turn", F.posexplode("ids").alias("seq", "id"))
    given = decode.decode_steps(rows, config, skip_special=False).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
    names = rows.select("stream_id", "conv_id", "turn").distinct()
    return names.join(given, "stream_id").select("conv_id", "turn", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "")).alias("decoded_md5"))


@query(r"SELECT item_id % 3 || '/' || item_id || '.txt' AS rel_path, 'Counted' AS status, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D \x85\x{A0}]+')) AS BIGINT) AS token_count FROM benchmark")
def folder_scan(spark, sf_dir):
    """The benchmark's items as files of a folder that all executors see, listed and counted."""
    root = files.shared_folder(spark, "scanned")
    rows = load(spark, sf_dir, "benchmark").select(F.concat_ws("/", F.col("item_id") % 3, F.concat(F.col("item_id"), F.lit(".txt"))).alias("rel_path"), F.coalesce("text", F.lit("")).alias("text"))
    files.write_files(rows, root)
    return files.scan(spark, root, word_level())
