"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed with either dictionary, in blocks of 512 bytes. How much smaller it gets with
one than with the other, relative to the larger size, tells which text it is like. A logistic
calibration turns this difference into the score. The difference alone can't tell text that repeats
itself, which both dictionaries shorten alike (see the README for figures); so the calibration also
takes both sizes relative to the text's, and the largest and smallest difference of a block, drawn
towards zero for short blocks. Dictionaries are trained on one half of a bounded sample of labelled
documents, the calibration on the other.

The driver gets 32,768 blocks of a label at most: if the sampled texts, of any length, have more, every
k-th block of all of them. For the calibration it only gets numbers, of the whole texts.

Cases: null and empty texts compress to a frame's header and get the score that follows. If only one
label was seen, every score is that label's; if none, 0. Repeated rows are scored alike. Other
columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, id_bucket, map_rows, text_bytes
from skyledger.llm.labelled import labelled_sample

LEVEL, BLOCK, FEATURES = 3, 512, 5
#: Blocks of a label that go to the driver at most, but for rounding: 16 MB.
MOST_BLOCKS = 32_768


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def pieces(text: bytes, step: int, start: int) -> list[bytes]:
    """Every step-th block, over the whole text."""
    return [text[i * BLOCK : (i + 1) * BLOCK] for i in range(start % step, -(-len(text) // BLOCK), step)]


def train_dictionary(parts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; the parts themselves, up to size bytes, where they are too few for one."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:] or b"\0" * 8


class CompressionModel:
    def __init__(self, good: bytes, bad: bytes):
        self.dictionaries, self.coef = (good, bad), np.zeros(FEATURES + 1)
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def features(self, text: bytes | None) -> tuple[float, ...]:
        if self._compressors is None:
            dicts = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
            for d in dicts:
                d.precompute_compress(level=LEVEL)
            self._compressors = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in dicts]
        text = text or b""
        first, second = (c.compress for c in self._compressors)
        pairs = [(len(first(b)), len(second(b))) for b in blocks(text)]
        good, bad = sum(x for x, _ in pairs), sum(x for _, x in pairs)
        each = [(x - y) / (max(x, y) + 32) for x, y in pairs]
        return (good - bad) / max(good, bad), float(np.log(good / (len(text) + 8))), float(np.log(bad / (len(text) + 8))), max(each), min(each)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 50) -> None:
        """x: the features of each text."""
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        x = np.c_[np.ones(len(x)), (x - self.mean) / self.spread]
        weight = weight / weight.sum()
        for _ in range(rounds):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))
            grad = x.T @ (weight * (p - y)) + l2 * self.coef
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(FEATURES + 1)
            self.coef = self.coef - np.linalg.solve(hess, grad)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        x = (np.array([self.features(t) for t in texts]).reshape(-1, FEATURES) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ self.coef[1:], -30, 30)))


def fit_quality(sample: DataFrame, stands_for: dict[int, float], *, dictionary_bytes: int = 65536) -> CompressionModel | float:
    """sample: (id, text, label), of a bounded number of rows. A number is the score of every text."""
    # every other row of a label, by its hash, for the dictionaries; the rest for the calibration
    place = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id", "text", F.lit(23)), F.xxhash64("id", "text")))
    sample = Scratch(sample.sparkSession, "quality").save(sample.withColumn("place", place), "sample")

    n_blocks = dict(sample.where("place % 2 = 1").groupBy("label").agg(F.sum(F.ceil(F.octet_length("text") / BLOCK))).collect())
    steps = {c: max(1, -(-int(n or 0) // MOST_BLOCKS)) for c, n in n_blocks.items()}

    def make_pieces():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(text_bytes(batch["text"]), batch["label"].to_pylist(), batch["place"].to_pylist(), strict=True)
            return pa.record_batch({"label": batch["label"], "place": batch["place"], "parts": pa.array([pieces(t or b"", steps[c], k // 2) for t, c, k in rows], pa.list_(pa.binary()))})

        return f

    got = map_rows(sample.where("place % 2 = 1"), make_pieces, "label int, place int, parts array<binary>").toArrow().sort_by([("label", "ascending"), ("place", "ascending")])
    labels = got["label"].to_numpy()
    if not 0 < labels.sum() < len(labels):
        return float(max(stands_for, default=0))
    parts = got["parts"].to_pylist()
    model = CompressionModel(*(train_dictionary([x for i in np.flatnonzero(labels == c) for x in parts[i]], dictionary_bytes) for c in (1, 0)))

    def make_features():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch({"label": batch["label"], "place": batch["place"], "x": pa.array([model.features(t) for t in text_bytes(batch["text"])], pa.list_(pa.float64()))})

        return f

    rest = sample.where("place % 2 = 0") if sample.where("place % 2 = 0").select("label").distinct().count() == 2 else sample
    got = map_rows(rest, make_features, "label int, place int, x array<double>").toArrow().sort_by([("label", "ascending"), ("place", "ascending")])
    y = got["label"].to_numpy().astype(float)
    model.calibrate(np.array(got["x"].to_pylist()), y, np.array([stands_for.get(int(c), 1.0) for c in y]))
    return model


def score_quality(docs: DataFrame, model: CompressionModel | float, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Adds score to the columns of keep (input column -> name)."""
    keep = keep or {}
    rows = docs.select(*[F.col(c).alias(name) for c, name in keep.items()], F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"] + ["score double"])

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = text_bytes(batch["_text"])
            scores = np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)
            return pa.record_batch({c: batch[c] for c in keep.values()} | {"score": pa.array(scores, pa.float64())})

        return f

    return map_rows(rows, make, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", id_bucket("doc_id", 3) == 1)
    sample, stands_for = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", id_bucket("doc_id", 3) != 1, per_class=1500)
    scored = score_quality(docs, fit_quality(sample, stands_for), "text", {"doc_id": "doc_id", "held_out": "held_out"})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
