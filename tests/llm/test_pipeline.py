"""The pipeline stage by stage, each against what its decision means on its own input."""

import corpus_pipeline as P
from vitrail.llm import bpe, decontam, nearsets, substrings


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontaminate", "tokenize"]
    outs = [docs]
    for name, stage in P.STAGES:
        outs.append(P.C.materialise(stage(spark, outs[-1], sf), name))
        if name != "tokenize":
            assert outs[-1].columns == docs.columns
    start, clean, near, cut, decon, done = map(rows, outs)
    insults = {"idiot", "moron", "scum"}
    assert len(clean) < len(start) and not any(insults & set(r.text.lower().split()) for r in clean.values())
    ids = sorted(clean)
    least = nearsets.brute([(d, clean[d].text) for d in ids])
    assert near.keys() == {ids[i] for *_, i in least.values()} and all(near[d] == clean[d] for d in near)
    assert len({r.text for r in near.values()}) == len(near) < len({r.text for r in clean.values()})
    removed = substrings.brute([(d, r.text) for d, r in near.items()])
    assert cut.keys() == {d for d, (n, gone, _) in removed.items() if not gone or gone < n}
    assert all(cut[d].text == near[d].text for d in cut if not removed[d][1])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {d for d, v in decontam.brute([(d, r.text) for d, r in cut.items()], items).items() if v[4]}
    assert decon.keys() == cut.keys() - dirty
    codec = bpe.codec(*bpe.vocabulary())
    assert done.keys() == decon.keys() and all(r.text == decon[d].text and r.n_tokens == len(codec.encode([r.text])[0]) for d, r in done.items())


def test_run_and_odd_rows(spark, sf):
    first = P.run(spark, sf)
    assert first.columns[-1] == "n_tokens" and first.count() > 0
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "w " * 50, "en", "s", 100), (3, "v " * 50, "en", "s", 100)]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in P.STAGES:
        docs = P.C.materialise(stage(spark, docs, sf), name)
    got = {(r.doc_id, r.text) for r in docs.collect()}
    assert (1, None) in got and (None, "a b c") in got and (2, "") not in got
    # Different texts under one id are two documents; both lose all but the first word of their first window.
    assert sorted(t for d, t in got if d == 3) == ["v", "w"]
    empty = spark.createDataFrame([], schema)
    for name, stage in P.STAGES:
        empty = P.C.materialise(stage(spark, empty, sf), name)
    assert empty.count() == 0


def test_near_copies_with_repeated_ids(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near, far = base + " end", " ".join(f"other{i}" for i in range(60))
    rows = [(1, far), (2, base), (2, far), (3, near), (3, "alone here"), (None, base), (None, "x y"), (None, "x y"), (4, ""), (5, None), (4, "alone here")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, far), (2, base), (3, "alone here"), (4, ""), (None, "x y")], key=str)
