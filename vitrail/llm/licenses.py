"""License scans by ordered signature rules.

A text without any gate word is done after one regular expression.  The others become words (A-Z
lowered; letters, digits and non-ASCII characters), one space before each.  Only rules whose keyword
is among a text's words are tried; each match becomes an interval of words.  Overlaps are resolved by
priority: in the order of their rules (of one rule the longer, then the earlier first) detections are
kept, and each kept one suppresses every later one that it contains or overlaps.  Only intervals that
hang together by overlaps are held against each other.

Native: built-in functions only, and all inside one row; texts are neither exploded nor shuffled.

Defined results: null is an empty text; contract phrases count at every place, also where their
detection is suppressed; score is the largest weight of a kept detection, 0 without any; repeated rows
are scanned each; input columns named n_words, base, detections, _t, _n, _k or _m are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import license_rules as L

#: Runs of word characters, before lowering (A-Z then count as word characters).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(x: Column) -> Column:
    """Words of a stretch: each has one space before it."""
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of the matches of ``pattern``, in order."""
    between = F.transform(F.split(norm, pattern, -1), _spaces)
    sizes = F.transform(F.regexp_extract_all(norm, pattern, 0), _spaces)
    pairs = F.zip_with(between, sizes, lambda b, m: F.struct(b.alias("b"), m.alias("m")))

    def step(_: Column, at: Column, x: Column) -> Column:
        s = at + x["b"]
        e = s + F.coalesce(x["m"], F.lit(0))
        return F.struct(e.alias("s"), F.when(x["m"].isNotNull(), F.struct(s.alias("s"), e.alias("e"))).alias("o"))

    return F.array_compact(arrays.scan(pairs, F.lit(0), step, "struct<s:int,e:int>"))


def _runs(ordered: Column) -> Column:
    """Intervals, in order of their starts, as runs that hang together by overlaps."""

    def step(_: Column, end: Column, x: Column) -> Column:
        return F.struct(F.greatest(end, x["e"]).alias("s"), (x["s"] >= end).alias("o"))

    def cut(opens: Column) -> Column:
        first = F.filter(F.transform(opens, lambda o, i: F.when(o, i)), lambda i: i.isNotNull())
        return arrays.let(first, lambda f: F.transform(f, lambda b, j: F.slice(ordered, b + 1, F.coalesce(F.get(f, j + 1), F.size(ordered)) - b)))

    return arrays.let(arrays.scan(ordered, F.lit(-1), step, "boolean"), cut)


def _resolved(run: Column) -> Column:
    """What stays of one run, rule by rule: a rule's own matches never overlap, so all that are left when
    its turn comes are kept, and what they overlap goes.

    Around an interval only those are looked at that start within a detection's width of it.
    """
    status = lambda: F.transform(run, lambda x: F.lit(0))
    base, widest = F.get(run, F.lit(0))["s"], F.array_max(F.transform(run, lambda x: x["e"] - x["s"]))
    # Of each word from the run's first on: the first interval that starts there or later.
    gaps = F.transform(run, lambda x, i: F.array_repeat(i, F.when(i == 0, 1).otherwise(x["s"] - F.get(run, i - 1)["s"])))
    levels = F.array_sort(F.array_distinct(F.transform(run, lambda x: x["priority"])))

    def around(firsts: Column, width: Column) -> Column:
        lo = lambda x: F.get(firsts, F.greatest(x["s"] - width + 1 - base, F.lit(0)))
        return F.transform(run, lambda x: F.struct(lo(x).alias("lo"), F.coalesce(F.get(firsts, x["e"] - base), F.size(run)).alias("hi")))

    def turn(near: Column):
        def one(before: Column, rule: Column) -> Column:
            kept = F.transform(before, lambda v, i: F.when((v == 0) & (F.get(run, i)["priority"] == rule), 1).otherwise(v))

            def gone(now: Column) -> Column:
                hit = lambda i: F.exists(
                    F.sequence(F.get(near, i)["lo"], F.get(near, i)["hi"] - 1),
                    lambda k: (F.get(now, k) == 1) & (F.get(run, k)["priority"] == rule) & (F.get(run, k)["s"] < F.get(run, i)["e"]) & (F.get(run, i)["s"] < F.get(run, k)["e"]),
                )
                return F.transform(now, lambda v, i: F.when((v == 0) & hit(i), 2).otherwise(v))

            return arrays.let(kept, gone)

        return F.aggregate(levels, status(), one)

    def settled(firsts: Column) -> Column:
        return arrays.let(widest, lambda w: arrays.let(around(firsts, w), turn))

    return arrays.let(arrays.let(F.flatten(gaps), settled), lambda done: F.filter(run, lambda x, i: F.get(done, i) == 1))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, base (places of contract phrases) and detections (kept ones).

    An input column of one of these names is dropped.
    """
    own = {"n_words", "base", "detections", "_t", "_n", "_k", "_m"}
    cols = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    gate = rf"(?i)(?<!{WORD[:-1]})(?:{'|'.join(g.replace(' ', BREAK) for g in L.GATE)})(?!{WORD[:-1]})"
    d = docs.select(*cols, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    norm = F.concat(F.regexp_replace(F.concat(F.lit(" "), F.translate("_t", UPPER, LOWER), F.lit(" ")), BREAK, " "))
    d = d.select(*cols, F.regexp_count("_t", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("_t").rlike(gate), norm).alias("_n"))

    table = [(i + len(L.BASE), label, key, f" (?:{body})(?= )", weight) for i, (label, key, body, weight) in enumerate(L.rules())]
    rules = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("priority", "label", "key", "pattern", "weight"), r)]) for r in table])
    keys = F.array_distinct(F.regexp_extract_all("_n", F.lit(f" ({'|'.join(sorted(L.keywords(), key=len, reverse=True))})(?= )"), 1))
    d = d.select("*", F.when(F.col("_n").isNotNull(), keys).alias("_k"))
    fits = F.filter(rules, lambda r: F.array_contains("_k", r["key"]) & F.rlike("_n", r["pattern"]))
    d = d.select("*", F.when(F.size("_k") > 0, fits).alias("_m"))

    def found(r: Column) -> Column:
        return F.transform(
            _places(F.col("_n"), r["pattern"]),
            lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")),
        )

    none_base = F.array().cast("array<struct<s:int,e:int,label:string>>")

    def contract(phrase: str, label: str) -> Column:
        at = _places(F.col("_n"), F.lit(f" {phrase}(?= )"))
        places = F.transform(at, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.lit(label).alias("label")))
        return F.when(F.contains("_n", F.lit(f" {phrase} ")), places).otherwise(none_base)

    base = F.concat(*[contract(*b) for b in L.BASE])
    none = F.array().cast("array<struct<s:int,e:int,priority:int,label:string,weight:double>>")
    every = F.flatten(F.transform("_m", found))
    # By start, then the longer first; runs, and what stays of each.
    keyed = F.array_sort(F.transform(every, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("t"), x["priority"].alias("priority"), x["label"].alias("label"), x["weight"].alias("weight"))))
    ordered = F.transform(keyed, lambda x: F.struct(x["s"].alias("s"), (-x["t"]).alias("e"), *(x[c].alias(c) for c in ("priority", "label", "weight"))))
    stays = lambda runs: F.flatten(F.transform(runs, lambda run: F.when(F.size(run) == 1, run).otherwise(_resolved(run))))
    kept = F.when(F.size("_m") > 0, arrays.let(ordered, lambda o: arrays.let(_runs(o), stays)))
    return d.select(
        *cols,
        "n_words",
        F.when(F.col("_n").isNotNull(), F.array_sort(base)).otherwise(none_base).alias("base"),
        F.coalesce(kept, none).alias("detections"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = scan(docs, keep=["doc_id"])
    base, more = F.transform("base", lambda x: x["label"]), F.transform("detections", lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    sure = F.aggregate("detections", F.lit(0.0), lambda a, x: F.greatest(a, x["weight"]))
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["s"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.greatest(sure, F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )


def brute(text: str | None) -> tuple:
    """The contract's base columns, word by word: for tests."""
    import re

    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    hits = []
    for phrase, label in L.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))
