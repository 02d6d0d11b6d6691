"""Language identification by nearest centroid.

A text is a vector of its lower-cased UTF-8 byte 1-, 2- and 3-grams (ASCII digits, marks and white space
count as one blank), hashed to ``DIMENSIONS`` places,
as (1 + log tf) * idf with unit length.  Each language has several centroids (spherical k-means), and
the language of the centroid with the largest cosine is predicted.  A text whose cosine is below that
centroid's ``floor`` (a low quantile of its training texts, less a margin) is marked as rejected.

idf counts all training rows; centroids are fitted on ``PER_LANGUAGE`` rows a language, chosen by hash.  Every value of ``lang`` is learned.
A worker holds the centroids of ``LANGUAGES`` values at most (4 bytes a dimension and centroid, 131 MB); where a column has more, its values stay a table, are
taken in blocks in alphabetical order, and a text's best so far goes from one block to the next through the shared folder.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any training row
all are ``und``; null languages are not learned; a null id counts as the empty string for the folds; ties go to
the language first in alphabetical order; repeated rows count each; very long texts are read whole, part by part; an empty table gives an empty result; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.common import materialize, small_batches
from specaudit.llm.ranking import ordered, with_rank

DIMENSIONS = 1 << 13
PER_LANGUAGE = 400
CENTROIDS = 4
#: Languages whose centroids a worker holds at once.
LANGUAGES = 1000
FLOOR_QUANTILE, FLOOR_MARGIN = 0.01, 0.05
PART = 1 << 20
#: ASCII letters and bytes of other scripts stay; digits, marks and white space become blanks.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs; long texts are read in parts."""
    data = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())
    out = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for at in range(0, len(data), PART):
        b = np.frombuffer(data[max(0, at - 2) : at + PART], np.uint8).astype(np.uint32)
        skip = min(2, at)
        code = b
        for n in (1, 2, 3):
            if n > 1:
                if len(b) < n:
                    break
                code = code[:-1] * np.uint32(256) + b[n - 1 :]
            # n-grams that end in the overlap were counted with the part before
            new = code[max(0, skip - n + 1) :]
            out += np.bincount(((new * np.uint32(4) + np.uint32(n)) * np.uint32(2654435761)) >> shift, minlength=DIMENSIONS)
    return out


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(len(tf), np.float32)
    (used,) = np.nonzero(tf)
    v[used] = (1 + np.log(tf[used])) * idf[used]
    norm = math.sqrt(float(v @ v))
    return v / norm if norm else v


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows; seeds are the rows farthest from those chosen before."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(axis=1)
        near[seeds] = 2
        seeds.append(int(np.argmin(near)))
    c = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(1e-12, float(np.linalg.norm(m)))
    return c


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, floors: np.ndarray):
        self.idf, self.languages, self.centroids, self.floors = idf, languages, centroids, floors

    def predict(self, texts: list[str | None], lang: list[str], score: list[float], rejected: list[bool]) -> tuple[list[str], list[float], list[bool]]:
        """The better of what is known of each text (``und`` with a score below 0 at first) and this model's languages."""
        lang, score, rejected = list(lang), list(score), list(rejected)
        which = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(which), 256):
            rows = which[at : at + 256]
            x = np.stack([weighted(counts(texts[k]), self.idf) for k in rows])
            cos = x @ self.centroids.T
            best = np.argmax(cos, axis=1)
            for k, j, c in zip(rows, best.tolist(), cos[np.arange(len(rows)), best].tolist(), strict=True):
                if c > score[k]:
                    lang[k], score[k], rejected[k] = self.languages[j], c, bool(c < self.floors[j])
        return lang, score, rejected


def held_out(id_col: str):
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(train: DataFrame, *, per_language: int = PER_LANGUAGE, n_centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Iterator[Model]:
    """Models of at most ``languages`` values each, in alphabetical order.  train: ``doc_id, text, lang``, all non-null but the id."""

    def df_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df += counts(text) > 0
                n += 1
        (used,) = np.nonzero(df)
        yield pa.RecordBatch.from_pydict({"place": pa.array([*used.tolist(), -1], pa.int32()), "n": pa.array([*df[used].tolist(), n], pa.int64())})

    # at most a row a dimension
    found = dict(map(tuple, train.select("text").mapInArrow(df_counts, "place int, n long").groupBy("place").agg(F.sum("n")).collect()))
    total = found.pop(-1, 0)
    idf = np.zeros(DIMENSIONS, np.float32)
    for place, n in found.items():
        idf[place] = math.log((1 + total) / (1 + n)) + 1
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.limit(languages + 1).collect()
    # a share of each language by hash, then exactly the first of it
    h = F.xxhash64("doc_id", "text")
    own = train.withColumn("h", h)
    if len(few) <= languages:
        if not few:
            return
        own = own.withColumn("n", F.create_map(*(F.lit(v) for r in few for v in r))[F.col("lang")])
    else:
        own = own.join(sizes, "lang")
    sample = own.where((F.col("h") / F.lit(2.0**64) + 0.5) < F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("n")))
    sample = sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [weighted(counts(t), idf).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "v": pa.array(v, pa.binary())})

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float32) for v in sorted(pdf["v"])])
        c = spherical_kmeans(x, n_centroids)
        cos = x @ c.T
        own = np.argmax(cos, axis=1)
        floors = [float(np.quantile(cos[own == j, j], FLOOR_QUANTILE)) - FLOOR_MARGIN if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "j": range(len(c)), "c": [r.tobytes() for r in c], "floor": floors})

    rows = sample.select("lang", "text").mapInArrow(vectors, "lang string, v binary").groupBy("lang").applyInPandas(cluster, "lang string, j int, c binary, floor double")
    def model(got: list) -> Model:
        got = sorted(got, key=lambda r: (r["lang"], r["j"]))
        return Model(idf, [r["lang"] for r in got], np.stack([np.frombuffer(r["c"], np.float32) for r in got]), np.array([r["floor"] for r in got]))

    if len(few) <= languages:
        yield model(rows.collect())
        return
    table = materialize(rows, "langid-centroids")
    numbered = materialize(with_rank(ordered(table.select("lang").distinct(), F.col("lang"), label="langid-languages"), "at"), "langid-languages")
    for first in range(0, numbered.count(), languages):
        yield model(table.join(numbered.where(F.col("at").between(first, first + languages - 1)), "lang").collect())


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row; learned from the rows that are not held out."""
    small_batches(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"))
    docs = docs.withColumn("held_out", held_out("doc_id"))
    train = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    state = "lang_pred string, score double, rejected boolean"

    def run(sent, more: bool):
        names = ["doc_id", "held_out", "lang_pred", "score", "rejected", *(["text"] if more else [])]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = sent.value.predict(batch.column("text").to_pylist(), *(batch.column(c).to_pylist() for c in names[2:5]))
                new = [pa.array(x, kind) for x, kind in zip(got, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *new, *(batch.column(c) for c in names[5:])], names=names)

        return step

    out = docs.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(-2.0).alias("score"), F.lit(True).alias("rejected"), "text")
    models = fit(train.select("doc_id", "text", "lang"), **how)
    model = next(models, None)
    while model is not None:
        after = next(models, None)
        own = out.mapInArrow(run(df.sparkSession.sparkContext.broadcast(model), after is not None), f"doc_id long, held_out boolean, {state}{', text string' if after else ''}")
        out, model = (materialize(own, "langid-so-far") if after else own), after
    return out.select("doc_id", "held_out", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"), "rejected")
