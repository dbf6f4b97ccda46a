"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with sample text; a text is
compressed with each of them, and the language of the smallest result wins.  Both sides are reduced
to what tells languages apart: letters, lower case, other characters as single spaces.

Where the best result is under NARROW better than the second the operator rejects: ``lang_id`` is
null and ``rejected`` is true, while ``lang_pred`` still names the best.  ``score`` is
``1 - exp(-STEEPNESS m)``, where m is the part by which the best result is smaller than the second:
from 0 (a tie, or no prediction) to 1.

Fitting reads a bounded sample: SAMPLE_DOCS documents of each language at most (those of least hash),
of each a window of SAMPLE_CHARS characters that begins at a hashed place.  Every language that a row
names has a dictionary.  Predicting reads whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
language with most rows, then to the first in the alphabet; with nothing to learn from every text is
``und``; repeated rows are predicted each, and one id counts once in the sample; input columns named
lang_pred, score, rejected or lang_id are replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from . import _sample as S

SAMPLE_DOCS, SAMPLE_CHARS = 256, 400
LEVEL, NARROW, STEEPNESS = 6, 0.01, 12.0

OUT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)

_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, bytes]:
    """Dictionary content of each language, most frequent first, from a bounded sample of ``docs``."""
    rows = docs.where(F.col(f"`{lang}`").isNotNull())
    # One row a language.
    top = rows.groupBy(F.col(f"`{lang}`").alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    ids = S.by_label(rows.where(F.length(f"`{text}`") > 0), lang, doc_id, SAMPLE_DOCS)
    sample = rows.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("label"), S.window(text, doc_id, SAMPLE_CHARS).alias("t"))
    # At most SAMPLE_DOCS ids a language; of rows with one id the least text.
    found = sample.join(F.broadcast(ids), ["id", "label"], "left_semi").groupBy("id", "label").agg(F.min("t").alias("t")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r.label, str(r.id))):
        out.setdefault(r.label, []).append(letters(r.t or ""))
    return {r.lang: b" ".join(out[r.lang]) for r in top if any(out.get(r.lang, ()))}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.packers = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(contents[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        raw = letters(text or "")
        if not self.langs or not _LETTER.search(text or ""):
            return "und", 0.0, True
        sizes = [pack(raw) for pack in self.packers]
        order = sorted((len(x), i) for i, x in enumerate(sizes))
        best, second = order[0], order[1] if len(order) > 1 else (order[0][0] * 2, 0)
        margin = (second[0] - best[0]) / max(1, second[0])
        return self.langs[best[1]], 1.0 - math.exp(-STEEPNESS * margin), margin < NARROW


def annotate(docs: DataFrame, contents: dict[str, bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score, rejected and lang_id (null where rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def make():
        classify = Classifier(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            got = [classify(t.as_py()) for t in texts]
            return [pa.array(c, k) for c, k in zip(zip(*got), (pa.string(), pa.float64(), pa.bool_()))]

        return work

    found = C.map_rows(docs, OUT, make, [text], keep)
    return found.withColumn("lang_id", F.when(~F.col("rejected"), F.col("lang_pred")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = S.fold("doc_id", 3) == 1
    contents = fit(docs.where(~held_out))
    found = annotate(docs.select("doc_id", "text"), contents, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
