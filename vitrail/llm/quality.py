"""Quality rules as a ledger of failure bits.

Every rule is evaluated once a document; bit r of ``failed_bits`` is set where rule r fails, and the
measurements stay beside it.  A policy is a versioned mask of rules, so any policy is applied, and
any ablation computed, by bitwise arithmetic on the ledger, without reading a text again.

Native: built-in functions only.  Repeated 5-word windows are found inside each row: windows are
hashed, hash and position are packed into one long and sorted, and neighbours with equal hashes are
occurrences of one window; no row is exploded, so no group of any size is gathered.

Defined results: a null text has no words, lines or symbols and fails ``too_short``; blank lines are
no duplicates; documents without words have ratios of 0; repeated rows are measured each; an input
column that has the name of a measurement, failed_bits or kept, or one of the working names _t, _w,
_h, _win, _p, _q, _r and _pos, is dropped or replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Up to so many words positions and hashes are packed into one long (20 and 44 bits).
PACKED_WORDS = 1 << 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails``: an SQL condition over the measurements."""

    name: str
    fails: str


#: Bit r belongs to the r-th rule.  Append only: bits in stored ledgers keep their meaning.
RULES = (
    Rule("too_short", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("symbol_flooded", "n_symbols > n_words"),
    Rule("words_too_long", "word_chars > 20 * n_words"),
    Rule("words_too_short", "n_words >= 10 and word_chars < 2 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 5 and 30 * n_dup_lines > n_words"),
    Rule("too_long", "n_words > 1000000"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Version -> names of the rules that reject.  ``base`` is the fixed part of the contract.
POLICIES = {
    "base": ("too_short", "repeated_windows"),
    "v1": ("too_short", "repeated_windows", "symbol_heavy", "words_too_long", "words_too_short", "duplicate_lines"),
    "strict": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[n] for n in POLICIES[policy])


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measurements (an input column of such a name is dropped)."""
    own = {*MEASURES, "_t", "_w", "_h", "_win", "_p", "_q", "_r", "_pos", "failed_bits", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    cols = [F.col(f"`{c}`") for c in keep]
    d = docs.select(*cols, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    d = d.select(*cols, "_t", F.array_remove(F.split("_t", SPACE), "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        *cols,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr("_t", "\n") > 0, F.aggregate(F.array(lines), F.lit(0), lambda a, x: F.size(x) - F.size(F.array_distinct(x))))
        .otherwise(0).cast("long").alias("n_dup_lines"),
    )
    kept = [*cols, *[F.col(c) for c in MEASURES[:4]]]
    d = d.select(*kept, F.when(F.size("_w") > WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"))
    every = F.sequence(F.lit(0), F.size("_h") - WINDOW)
    window = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WINDOW)])
    d = d.select(*kept, F.transform(every, window).alias("_win"))
    # Most documents repeat no window and stop here; the others sort theirs.
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    position = F.lit(PACKED_WORDS - 1).cast("long")
    packed = F.array_sort(F.transform("_win", lambda h, i: h.bitwiseAND(F.bitwise_not(position)).bitwiseOR(i.cast("long"))))
    place = lambda x: x.bitwiseAND(position).cast("int")
    pairs = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def mixed(s: Column) -> Column:
        """Whether different windows share the packed bits, so that their places may stand mixed."""
        bits = lambda x: x.bitwiseAND(F.bitwise_not(position))
        differ = lambda a, b: F.get(F.col("_win"), place(a)) != F.get(F.col("_win"), place(b))
        return F.size(F.filter(s, lambda x, i: (i > 0) & (bits(x) == bits(F.get(s, i - 1))) & differ(x, F.get(s, i - 1)))) > 0

    def flagged(ordered: Column, at) -> Column:
        """Positions, ascending, of the entries whose neighbour in ``ordered`` is the same window."""
        same = lambda a, b: F.get(F.col("_win"), at(a)) == F.get(F.col("_win"), at(b))
        near = lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)),
        )
        return F.array_sort(F.transform(near(ordered), at))

    d = d.select(*kept, "_win", F.when(repeats & (F.size("_win") < PACKED_WORDS), packed).alias("_p"), repeats.alias("_r"))
    d = d.select(*kept, "_win", F.when(~F.coalesce(mixed(F.col("_p")), F.lit(False)), F.col("_p")).alias("_p"), "_r")
    d = d.select(*kept, "_win", "_p", F.when(F.col("_r") & F.col("_p").isNull(), pairs).alias("_q"))
    d = d.select(*kept, F.coalesce(F.when(F.col("_p").isNotNull(), flagged(F.col("_p"), place)), F.when(F.col("_q").isNotNull(), flagged(F.col("_q"), lambda x: x["i"]))).alias("_pos"))
    # A flagged window adds the words that the one before it has not covered.
    covered = F.aggregate(
        "_pos",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return d.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measurements and failed_bits."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(BIT[r.name])).otherwise(0).cast("long"))
    return measure(docs, text, keep).withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """``entries`` with kept: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and kept without it.

    One pass: ledgers are first counted by their bits, so at most 2^rules rows are combined.
    """
    m = mask(policy)
    by_bits = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    own = lambda bit: F.col("b").bitwiseAND(F.lit(bit).cast("long"))
    sums = by_bits.agg(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(own(BIT[name]) != 0, F.col("n"))), F.lit(0)).alias("fails"),
                F.coalesce(F.sum(F.when(F.col("b") == BIT[name], F.col("n"))), F.lit(0)).alias("fails_alone"),
                F.coalesce(F.sum(F.when(own(m & ~BIT[name]) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
            ).alias(f"r{i}")
            for i, name in enumerate(POLICIES[policy])
        ]
    )
    return sums.select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(POLICIES[policy]))])))


def query(spark, sf_dir: str, policy: str = "v1") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = apply_policy(ledger(docs, keep=["doc_id"]), policy)
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return found.select("doc_id", *MEASURES, base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "failed_bits")


def _sql() -> str:
    bits = " | ".join(f"(CASE WHEN {r.fails.replace('and', 'AND')} THEN {BIT[r.name]} ELSE 0 END)" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT doc_id, t, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string([x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o], ' ') AS g,
             lead(x, 4) OVER o AS last FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE last IS NOT NULL) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS k(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
      WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(length(array_to_string(w.w, '')), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, ({bits})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {mask("base")}) <> 0 AS base_failed,
       (failed_bits & {mask("v1") | mask("base")}) = 0 AS kept, failed_bits FROM f"""


SQL = _sql()
