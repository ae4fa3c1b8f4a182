"""Operator 6: language identification by nearest centroids.

A text becomes a TF-IDF vector of hashed byte n-grams, normalised to length 1.
Inverse document frequencies count every labelled training text. Each language
gets several centroids by spherical k-means over a bounded sample of its
training texts (``per_language`` different ones, those with the smallest hash; rows of the
language are thinned by a bound on the hash before any are shuffled, so that of a language
whose rows are mostly copies there may be fewer). A text takes
the language of the centroid with the largest cosine, which is its score; one
that is far from every centroid, measured by how far the sample itself lies, is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cuts, drop, ship, written

DIMS = 4096
_BITS = 12
#: A-Z to lower case; ASCII other than letters becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Characters from which a text must come as near as the sample did; shorter ones in proportion.
SURE = 40


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams (1 to 4 bytes, words parted by one space)."""
    a = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(DIMS, np.int64)
    code = a
    for size in range(1, 5):
        if size > 1:
            code = (code[:-1] << np.uint32(8)) ^ a[size - 1 :]
        if not len(code):
            break
        mixed = ((code + np.uint32(size * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
        total += np.bincount(mixed, minlength=DIMS)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    counts = grams(text)
    v = np.zeros(DIMS, np.float32)
    found = np.flatnonzero(counts)
    v[found] = (1 + np.log(counts[found])) * idf[found]
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def cluster(x: np.ndarray, k: int, seed: int = 6, rounds: int = 15) -> np.ndarray:
    """Spherical k-means: centroids of length 1, the first ones far apart."""
    rng = np.random.default_rng(seed)
    c = x[[0]]
    while len(c) < min(k, len(x)):
        far = np.maximum(0, 1 - (x @ c.T).max(axis=1))
        if far.sum() < 1e-6:
            break
        c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.vstack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new.astype(np.float32)
    return c


def fit(labelled: DataFrame, per_language: int = 1000, centroids: int = 4, slack: float = 0.6) -> dict:
    """Learn from columns text and lang; rows without a lang or a letter are left out.

    The model is small: DIMS weights and ``centroids`` vectors for each language.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in cuts(batches):
            for text in batch["text"].to_pylist():
                if has_letter(text):
                    total += grams(text) > 0
                    n += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int64()), pa.array([n, *total[found].tolist()], pa.int64())], ["dim", "n"])

    df = np.zeros(DIMS, np.int64)
    n_texts = 0
    for r in rows.select("text").mapInArrow(spread, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        if r["dim"] < 0:
            n_texts = r["n"]
        else:
            df[r["dim"]] = r["n"]
    idf = (np.log((1 + n_texts) / (1 + df)) + 1).astype(np.float32)

    # A language's sample: the per_language least hashes of its different texts. The aggregate below keeps the
    # languages' counts, so that a hash bound for each thins its rows before any are shuffled.
    lettered = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("h"))
    sizes = lettered.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("rows") + F.lit(20.0) * F.sqrt(F.lit(float(per_language))) / F.col("rows"))
    bound = sizes.select("lang", (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("bound"))
    thin = lettered.join(F.broadcast(bound), "lang").where("h < bound OR bound >= 9.2e18").select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h")
    names, names_path = written(thin.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).select("lang", "h"), "sample")
    chosen = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(names), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([vector(t, idf) for t in pdf.sort_values(["h", "text"])["text"]])
        c = cluster(x, centroids)
        least = slack * float(np.quantile((x @ c.T).max(axis=1), 0.005))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "least": least, "c": [v.astype(np.float32).tobytes() for v in c]})

    found = chosen.select("lang", "h", "text").groupBy("lang").applyInPandas(learn, "lang string, least double, c binary").orderBy("lang", "c").collect()
    drop(spark, names_path)
    return {
        "idf": idf,
        "langs": [r["lang"] for r in found],
        "least": np.array([r["least"] for r in found], np.float32),
        "centroids": np.vstack([np.frombuffer(r["c"], np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32),
    }


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Every row of ``docs`` with lang_pred, score (0 to 1) and rejected.

    ``und`` with score 0 and rejected is given to a null text, one without a
    letter, and to all if nothing was learned. Only text is looked at. Columns
    that clash with the three get replaced; repeated rows get equal results.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    known = spark.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in cuts(batches):
            lang, score, out = [], [], []
            for text in batch["text"].to_pylist():
                if not m["langs"] or not has_letter(text):
                    lang.append(UNKNOWN), score.append(0.0), out.append(True)
                    continue
                cos = m["centroids"] @ vector(text, m["idf"])
                i = int(cos.argmax())
                lang.append(m["langs"][i])
                score.append(float(min(1, max(0, cos[i]))))
                out.append(bool(cos[i] < m["least"][i] * min(1.0, len(text) / SURE)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(near, schema)
