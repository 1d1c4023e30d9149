"""Quality rules as a bitmask ledger, by DataFrame and SQL functions alone.

Every rule is evaluated once: a document's measurements and the bits of the rules that it fails go into a ledger.
Policies are versioned masks over these bits, so that another policy, or an ablation of one rule, needs the ledger
only and never the texts. Rules that a later version adds take the next free bits.

Null and empty texts have no words and fail too_few_words. Repeated rows give repeated results, an empty table an
empty ledger. Texts are measured whole, whatever their length. Only the columns asked for are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import SPACE

#: Word positions are packed beside a hash into one long; longer texts take the exact path.
POSITION_BITS = 21
MOST_WORDS = 1 << POSITION_BITS


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements


RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "n_words > 0 AND 5 * n_symbols > n_words"),
    Rule("shouting", 3, "n_words > 0 AND 2 * n_upper > n_letters AND n_letters > 0"),
    Rule("exclamations", 4, "n_words > 0 AND 5 * n_exclaims > n_words"),
    Rule("word_runs", 5, "n_words > 0 AND 100 * n_run_words > 30 * n_words"),
    Rule("duplicate_lines", 6, "n_lines >= 8 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("tables", 7, "n_words > 0 AND 100 * n_bar_words > 12 * n_words"),
    Rule("word_length", 8, "n_words > 0 AND (word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words)"),
    Rule("few_letters", 9, "n_words > 0 AND 2 * n_letters < word_chars"),
)
BITS = {r.name: 1 << r.bit for r in RULES}
#: Policies by version: which bits reject a document.
POLICIES = {
    "base": BITS["too_few_words"] | BITS["repeated_windows"],
    "v1": sum(BITS.values()),
}


def window_parts(words: str) -> tuple:
    """The expressions that count words which lie in a three-word window found twice or more in the text.

    Windows are hashed and packed with their position into longs, which sort fast; windows of equal hash bits lie side
    by side. If neighbours of equal bits differ in their words, or the text is too long for the packing, the windows
    themselves are sorted instead: the result is exact either way.
    """
    w = F.col(words)
    last = F.size(w) - 3

    def at(k: Column) -> list[Column]:
        return [w[k], w[k + 1], w[k + 2]]

    def position(code: Column) -> Column:
        return code.bitwiseAND(F.lit(MOST_WORDS - 1))

    def same_bits(a: Column, b: Column) -> Column:
        return F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)

    def differ(a: Column, b: Column) -> Column:
        i, j = position(a).cast("int"), position(b).cast("int")
        return (w[i] != w[j]) | (w[i + 1] != w[j + 1]) | (w[i + 2] != w[j + 2])

    def covered(starts: Column) -> Column:
        """Words covered by windows that begin at these sorted places."""
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda acc, s: F.struct((acc["n"] + F.least(F.lit(3), s - acc["end"])).alias("n"), s.alias("end")), lambda acc: acc["n"].cast("long"))

    keep = F.lit(~(MOST_WORDS - 1)).cast("long")
    codes = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(*at(k)).bitwiseAND(keep).bitwiseOR(k.cast("long"))))
    return w, last, at, position, same_bits, differ, covered, codes


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the measurements of each text."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    rows = df.select(*keep, F.col(text).alias("_text")).select(
        *keep,
        F.array_remove(F.split(t, SPACE + "+"), "").alias("_words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
    )
    w, last, at, position, same_bits, differ, covered, codes = window_parts("_words")
    rows = rows.withColumn("_codes", F.when((last >= 1) & (last < MOST_WORDS), codes))
    c = F.col("_codes")
    pairs = F.filter(F.sequence(F.lit(0), F.size(c) - 2), lambda k: same_bits(c[k], c[k + 1]))
    rows = rows.withColumn("_pairs", F.when(F.size(c) >= 2, pairs))
    p = F.col("_pairs")
    # Texts that the packing can't decide: exact windows, sorted as they are.
    exact = (c.isNull() & (last >= 1)) | F.exists(p, lambda k: differ(c[k], c[k + 1]))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(*[x.alias(f"w{n}") for n, x in enumerate(at(k))], k.alias("k"))))
    rows = rows.withColumn("_windows", F.when(exact, windows))
    x = F.col("_windows")

    def equal(a: Column, b: Column) -> Column:
        return (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])

    twins = F.filter(F.sequence(F.lit(0), F.size(x) - 2), lambda k: equal(x[k], x[k + 1]))
    rows = rows.withColumn("_twins", F.when(F.size(x) >= 2, twins))
    slow = F.concat(F.transform("_twins", lambda k: x[k]["k"]), F.transform("_twins", lambda k: x[k + 1]["k"]))
    fast = F.concat(F.transform(p, lambda k: position(c[k]).cast("int")), F.transform(p, lambda k: position(c[k + 1]).cast("int")))
    rows = rows.withColumn("_starts", F.sort_array(F.array_distinct(F.when(x.isNotNull(), slow).when(F.size(p) > 0, fast).otherwise(F.array().cast("array<int>")))))
    n_lines = F.size("_lines").cast("long")
    runs = F.size(F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda k: w[k] == w[k - 1]))
    return rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (n_lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("_starts")).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        "n_letters",
        "n_upper",
        "n_exclaims",
        F.when(F.size(w) >= 2, runs).otherwise(0).cast("long").alias("n_run_words"),
        (F.size(w) - F.size(F.array_remove(w, "|"))).cast("long").alias("n_bar_words"),
    )


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and fail_mask: bit k is set if the rule of bit k fails.

    The rows pass through a generator of one row each, for Catalyst would move filters on the mask below the
    projections that measure, and evaluate these once for every time the filter names them.
    """
    mask = F.lit(0).cast("long")
    for r in rules:
        mask = mask.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    found = measure(df, text, keep).withColumn("fail_mask", mask)
    one = F.explode(F.array(F.struct(*[F.col(c) for c in found.columns if c not in keep]))).alias("_one")
    return found.select(*keep, one).select(*keep, "_one.*")


def rejects(policy: str | int) -> Column:
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(found: DataFrame, policy: str | int = "v1") -> DataFrame:
    return found.withColumn("base_failed", rejects("base")).withColumn("kept", ~(rejects("base") | rejects(policy)))


def ablations(found: DataFrame, policy: str | int = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule: documents that fail it, that fail it alone under the policy, and that would be kept without it."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    active = F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long"))
    aggregates = [F.count(F.lit(1)).alias("n"), F.count_if(active == 0).alias("kept"), F.bit_or("fail_mask").alias("any_mask"), F.bit_and("fail_mask").alias("all_mask")]
    for r in rules:
        bit = F.lit(1 << r.bit).cast("long")
        aggregates += [F.count_if(F.col("fail_mask").bitwiseAND(bit) != 0).alias(f"f{r.bit}"), F.count_if(active == bit).alias(f"o{r.bit}")]
    one = found.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_failed_alone"), (F.col("kept") + F.col(f"o{r.bit}")).alias("n_kept_without")) for r in rules])
    return one.select(F.inline(rows))


def accepted(df: DataFrame, policy: str | int = "v1", text: str = "text") -> DataFrame:
    """The rows of df that the policy keeps, with df's columns."""
    held = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(text).alias("_text"))
    return apply_policy(ledger(held, "_text", ("_row",)), policy).where("kept").select("_row.*")
