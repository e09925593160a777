"""Language identification by nearest centroid.

Texts become vectors of hashed byte trigrams (ASCII letters folded, ASCII digits and punctuation as
blanks), weighted by TF-IDF and normalised. Each language has several centroids, found by spherical
k-means on a bounded sample of labelled rows. A text takes the language of the centroid with the
largest cosine. It is rejected where that cosine falls far below what training texts of like length
have, where the text is null, or where it holds no letter.

Cases: null text and text without letters give `und`, score 0 and rejected. If nothing can be
learned (no labelled row), every text gives `und`. Ties go to the first language in sort order.
Repeated rows are scored alike. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import bounded_sample, id_bucket, map_rows, release, text_bytes, whole_rows, with_columns

DIMS = 4096
UNKNOWN = "und"
#: ASCII letters folded; control characters, digits and punctuation become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigram_counts(text: bytes) -> np.ndarray:
    a = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    codes = ((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(2654435761)
    counts = np.bincount(codes >> np.uint32(20), minlength=DIMS)
    counts[np.uint32(0x202020 * 2654435761 & 0xFFFFFFFF) >> np.uint32(20)] = 0  # three blanks say nothing
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length; starts from points far from one another, without chance."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        near = np.max(x @ np.array(centres).T / np.maximum(np.linalg.norm(centres, axis=1), 1e-12), axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        of = np.argmax(x @ c.T, axis=1)
        c = np.array([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class LanguageModel:
    """idf, centroids with their languages, and the least cosine accepted in each band of length."""

    def __init__(self, idf, centroids, languages, floors):
        self.idf, self.centroids, self.languages, self.floors = idf, centroids, languages, floors

    @classmethod
    def fit(cls, counts: np.ndarray, langs: list[str], k: int, slack: float) -> LanguageModel | None:
        if not len(counts):
            return None
        idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x, langs = weighted(counts, idf), np.array(langs, object)
        names = sorted(set(langs))
        parts = [spherical_kmeans(x[langs == name], k) for name in names]
        centroids = np.concatenate(parts).astype(np.float32)
        languages = [name for name, c in zip(names, parts, strict=True) for _ in c]
        best = (x @ centroids.T).max(1)
        band = np.log2(counts.sum(1) + 1).astype(int).clip(0, 31)
        floors, last = np.zeros(32, np.float32), 0.0
        for b in range(32):
            if (band == b).sum() >= 20:
                last = slack * float(np.quantile(best[band == b], 0.02))
            floors[b] = last
        return cls(idf, centroids, languages, floors)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        cos = weighted(counts, self.idf) @ self.centroids.T
        best = cos.argmax(1)
        score = cos[np.arange(len(cos)), best].clip(0, 1)
        band = np.log2(counts.sum(1) + 1).astype(int).clip(0, 31)
        return [self.languages[j] for j in best], score, score < self.floors[band]


def fit_language_id(docs: DataFrame, text_col: str, lang_col: str, id_col: str, *, per_language: int = 400, centroids: int = 4, slack: float = 0.5) -> LanguageModel | None:
    """Fits on at most per_language different rows of each language; the sample has 100,000 rows at most."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sample = bounded_sample(rows, "lang", ["id", "text"], per_language)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = [trigram_counts(t) for t in text_bytes(batch["text"])]
            at = [np.flatnonzero(c) for c in kept]
            return pa.record_batch({
                "id": batch["id"], "lang": batch["lang"],
                "at": pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())),
                "n": pa.array([c[x].astype(np.int32) for c, x in zip(kept, at, strict=True)], pa.list_(pa.int32())),
            })

        return f

    got = sorted(map_rows(sample, make, "id string, lang string, at array<int>, n array<int>").collect(), key=lambda r: (r["lang"], r["id"] or "", r["at"], r["n"]))
    counts = np.zeros((len(got), DIMS), np.int32)
    for row, r in zip(counts, got, strict=True):
        row[r["at"]] = r["n"]
    return LanguageModel.fit(counts, [r["lang"] for r in got], centroids, slack)


def identify_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """keep: input columns to carry, by the name they get. Adds lang_pred, score and rejected."""
    rows = docs.select(*[F.col(c).alias(name) for c, name in (keep or {}).items()], F.col(text_col).alias("_text"))
    return predicted(rows, model)


def predicted(rows: DataFrame, model: LanguageModel | None) -> DataFrame:
    """rows with lang_pred, score and rejected in place of `_text`."""
    carried = [c for c in rows.columns if c != "_text"]

    def make():
        import regex

        letter = regex.compile(r"\p{L}").search

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
            for start in range(0, batch.num_rows, 512):
                texts = text_bytes(batch["_text"].slice(start, 512))
                known = [model is not None and t is not None and letter(t.decode("utf-8", "replace")) is not None for t in texts]
                name, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if any(known):
                    at = np.flatnonzero(known)
                    got, score[at], out[at] = model.predict(np.array([trigram_counts(texts[i]) for i in at]))
                    for i, x in zip(at, got, strict=True):
                        name[i] = x
                names += name
                scores.append(score)
                rejected.append(out)
            cols = {c: batch[c] for c in carried}
            return pa.record_batch(cols | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.concatenate(scores)), "rejected": pa.array(np.concatenate(rejected))})

        return f

    return map_rows(rows, make, with_columns(rows, "lang_pred string, score double, rejected boolean", without="_text"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", id_bucket("doc_id", 4) == 2)
    model = fit_language_id(docs.where(~F.col("held_out")), "text", "lang", "doc_id")
    return identify_language(docs, model, "text", {"doc_id": "doc_id", "held_out": "held_out"})


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    Null texts and texts without a letter are rejected. If nothing can be learned, there is no
    classifier to reject anything, and all rows stay. Rows without id, and repeated rows, are judged
    like any others. All columns are carried, whatever their names.
    """
    model = fit_language_id(docs.where(id_bucket("doc_id", 4) != 2), "text", "lang", "doc_id")
    release()  # the sample's arrays, which the driver would hold through the later stages
    if model is None:
        return docs
    return predicted(whole_rows(docs, _text=F.col("text")), model).where(~F.col("rejected")).select("row.*")
