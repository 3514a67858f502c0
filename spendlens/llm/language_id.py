"""Language identification by hierarchical discrimination.

A linear support vector machine (one against the rest) predicts the language
family; inside the family, one-versus-one linear machines vote between its
languages. Features are the square roots of the shares of hashed byte bigrams
and trigrams of the lower-cased letters, which have unit length.

The machines are fitted on a sample of labelled rows: of every language the same
number, ``SAMPLE_ROWS`` together or ``LEAST_ROWS`` of each if languages are many, or
all its rows if it has fewer. Sampled texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches

FEATURES = 4096
SAMPLE_ROWS, LEAST_ROWS = 1200, 8
#: Rows are drawn by their hash so many times as often as wanted, and of those drawn the ones with the least hashes stay.
OVER = 4
UNDETERMINED = "und"
BIAS = 0.3
#: ISO 639-1 codes of language families. A code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi ur bn pa gu mr ne si",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Bytes that are no part of a word in the features: ASCII but letters.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id as text is a multiple of 5; so are those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(text: str) -> np.ndarray:
    """The unit vector of a text."""
    b = _LETTERS[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    mixed = np.concatenate([two * np.uint32(0x9E3779B1), (three + np.uint32(1 << 24)) * np.uint32(0x85EBCA6B)]) >> np.uint32(20)
    return np.sqrt(np.bincount(mixed, minlength=FEATURES) / max(1, len(mixed)))


class Linear:
    """A linear support vector machine with squared hinge loss, fitted by dual coordinate descent."""

    def __init__(self, x: np.ndarray, which: np.ndarray, positive: np.ndarray, c: float = 20.0, rounds: int = 30, seed: int = 7):
        """The rows ``which`` of x, unit vectors; positive: those of one side. No copy of x is made."""
        w, bias, a, own = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), 1 + BIAS * BIAS + 1 / (2 * c)
        y = np.where(positive, 1.0, -1.0)
        order = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in order.permutation(which):
                margin = y[i] * (w @ x[i] + BIAS * bias)
                step = max(0.0, a[i] - (margin - 1 + a[i] / (2 * c)) / own) - a[i]
                if step:
                    a[i] += step
                    w += step * y[i] * x[i]
                    bias += step * y[i] * BIAS
        self.w, self.b = w, BIAS * bias

    def __call__(self, v: np.ndarray) -> float:
        return float(v @ self.w) + self.b


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * margin)))


class Model:
    """Family first, then one-versus-one inside it."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        labels, self.members = np.array(langs), {}
        for lang in sorted(set(langs)):
            self.members.setdefault(FAMILY.get(lang, lang), []).append(lang)
        family = np.array([FAMILY.get(lang, lang) for lang in langs])
        one = lambda mask, of: Linear(x, np.flatnonzero(of), mask)
        every = np.ones(len(x), bool)
        self.families = {f: one(family == f, every) for f in self.members} if len(self.members) > 1 else {}
        self.pairs = {(a, b): one(labels == a, (labels == a) | (labels == b)) for m in self.members.values() for a, b in combinations(m, 2)}

    def predict(self, text: str) -> tuple[str, float]:
        v, sure = features(text), 1.0
        family = next(iter(self.members))
        if self.families:
            margins = {f: m(v) for f, m in self.families.items()}
            family = max(margins, key=margins.get)
            sure = _sure(margins[family])
        langs = self.members[family]
        votes, total = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            margin = self.pairs[a, b](v)
            votes[a if margin >= 0 else b] += 1
            total[a] += margin
            total[b] -= margin
        best = max(langs, key=lambda k: (votes[k], total[k]))
        return best, sure * (_sure(total[best] / (len(langs) - 1)) if len(langs) > 1 else 1.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = [features(t.as_py()).astype(np.float32).tobytes() for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.binary())], ["lang", "h", "v"])


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def limits(counts: dict[str, int]) -> tuple[int, dict[str, int]]:
    """Rows wanted of each language, and of each the signed 64-bit hash below which its rows are drawn: never below one row in expectation, whatever the counts."""
    each = max(LEAST_ROWS, SAMPLE_ROWS // max(1, len(counts)))
    return each, {k: min((1 << 63) - 1, -(1 << 63) + (OVER * each << 64) // max(1, n)) for k, n in counts.items()}


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Model | None:
    """The machines learned from the rows not held out whose lang is not null and whose text has a letter; None if there are none.

    Every language is learned. What goes to the driver are the languages with their counts, and the sample's vectors.
    """
    known = small_batches(docs).filter(~held_out(id_col) & F.col(lang).isNotNull() & has_letter(text)).select(F.xxhash64(id_col).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    each, below = limits({r.lang: r["count"] for r in known.groupBy("lang").count().collect()})
    if not below:
        return None
    limit = F.create_map(*[F.lit(x) for pair in sorted(below.items()) for x in pair])[F.col("lang")]
    drawn = known.filter(F.col("h") <= limit).select("lang", "h", "text").mapInArrow(_vectors, "lang string, h long, v binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "v"))
    rows = drawn.withColumn("n", nth).filter(F.col("n") <= each).select("lang", "v").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.v)))
    return Model(np.stack([np.frombuffer(r.v, np.float32) for r in rows]), [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    lang_pred is a learned language, or `und` (score 0) where the text is null, empty or without a letter, or where
    nothing was learned; score is in 0..1. Other columns pass through; those of the added names are replaced.
    """
    docs = small_batches(docs).drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    use = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers for each machine

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([use.value.predict(t) if t is not None else (UNDETERMINED, 0.0) for t in batch], columns=["lang_pred", "score"])

    found = F.pandas_udf(predict, "lang_pred string, score double")(F.when(has_letter(text), F.col(text)))
    return docs.select(F.struct("*").alias("row"), found.alias("found")).select("row.*", "found.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told (not `und`), with the columns of ``docs``."""
    return identify(docs, fit(docs)).filter(F.col("lang_pred") != UNDETERMINED).select(docs.columns)
