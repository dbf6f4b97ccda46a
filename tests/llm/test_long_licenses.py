"""License scans of long texts: time grows with the text, and overlaps resolve as a plain resolver does."""

import random
import time

from pyspark.sql import functions as F

from vitrail.llm import licenses


def plain(found):
    """(s, e, priority) in the order of rules, each dropping the later ones that it overlaps."""
    kept = []
    for x in sorted(found, key=lambda x: (x[2], x[0] - x[1], x[0])):
        if not any(k[0] < x[1] and x[0] < k[1] for k in kept):
            kept.append(x)
    return sorted(kept)


def test_runs_resolve_like_a_plain_resolver(spark):
    dice = random.Random(2)
    cases = []
    for _ in range(60):
        found = []
        for rule in range(dice.choice([1, 2, 5, 9])):
            at = dice.randint(0, 4)
            while at < dice.choice([6, 30, 120]):
                n = dice.randint(1, dice.choice([2, 6, 15]))
                found.append((at, at + n, rule))
                at += n + dice.randint(0, 6)
        cases.append(sorted(found, key=lambda x: (x[0], -x[1], x[2])))
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x array<struct<s:int,e:int,priority:int>>")
    runs = df.select("i", "x", licenses._runs(F.col("x")).alias("runs"))
    stays = runs.select("i", "runs", F.flatten(F.transform("runs", licenses._resolved)).alias("kept")).collect()
    for r in stays:
        assert [tuple(x) for run in r.runs for x in run] == cases[r.i]
        ends = [max(x.e for x in run) for run in r.runs]
        assert all(run[0].s >= e for run, e in zip(r.runs[1:], ends))
        assert sorted(tuple(x) for x in r.kept) == plain(cases[r.i])


def test_long_texts(spark):
    texts = ["mit license apache license " * 75_000, "license mit " * 100_000, "gnu general public license version 2 or later mit license " * 30_000, "word " * 300_000 + "cc by 4.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in licenses.scan(df).select("doc_id", "n_words", F.size("base").alias("base"), F.size("detections").alias("kept"), F.get("detections", F.lit(0))["s"].alias("first")).collect()}
    assert time.time() - began < 600  # a square of the matches would take hours
    assert got[0].n_words == 300_000 and got[0].base == 150_000 and got[0].kept == 150_000
    assert got[1].base == 99_999 and got[2].base == 60_000 and got[2].kept == 60_000
    assert (got[3].n_words, got[3].base, got[3].first) == (300_004, 1, 300_000)
