"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text (ASCII letters folded) and, for words of six bytes and more,
their first five bytes; all are hashed. The terms most associated with the label in a bounded sample
of labelled documents become the machine's inputs. Besides a weight for each term it learns a short
vector, and the inner product of two terms' vectors is their interaction's weight: so an insult can
count for more beside a group mention than both do alone. The score is a probability.

Cases: null and empty texts have no terms and get the score of the intercept. If only one label was
seen, every score is that label's; if none, 0. Repeated rows are scored alike. Other columns of the
input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import id_bucket, map_rows, text_bytes
from skyledger.llm.labelled import labelled_sample

SPACE = 1 << 20
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_hashes(text: bytes | None, memo: dict[bytes, tuple[int, ...]]) -> set[int]:
    import xxhash

    out: set[int] = set()
    for w in set(text.translate(FOLD).split()) if text else ():
        got = memo.get(w)
        if got is None:
            if len(memo) > 200_000:
                memo.clear()
            got = (xxhash.xxh32_intdigest(w) % SPACE,)
            if len(w) > 5:
                got += (xxhash.xxh32_intdigest(w[:5], 1) % SPACE,)
            memo[w] = got
        out.update(got)
    return out


class FactorizationMachine:
    """inputs: hashes in order; bias, weights and vectors of the inputs."""

    def __init__(self, inputs: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.inputs, self.bias, self.weights, self.vectors = inputs, bias, weights, vectors
        self.place = {int(h): i for i, h in enumerate(inputs)}
        self.known = frozenset(self.place)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, inputs: np.ndarray, weight: np.ndarray, *, factors: int = 8, rounds: int = 60, rate: float = 0.02, l2: float = 2e-4, seed: int = 5) -> FactorizationMachine:
        rng = np.random.default_rng(seed)
        n, d = x.shape
        p = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        params = [np.array([np.log(p / (1 - p))]), np.zeros(d), rng.normal(0, 0.01, (d, factors))]
        m, v, step = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0
        weight = weight / weight.mean()
        for _ in range(rounds):
            order = rng.permutation(n)
            for start in range(0, n, 256):
                at = order[start : start + 256]
                xb, b, w, f = x[at], *params
                xf = xb @ f
                z = b[0] + xb @ w + 0.5 * ((xf**2).sum(1) - xb @ (f**2).sum(1))
                g = weight[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
                grads = [np.array([g.sum()]), xb.T @ g + l2 * w, xb.T @ (g[:, None] * xf) - (xb.T @ g)[:, None] * f + l2 * f]
                step += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(inputs, float(params[0][0]), params[1], params[2])

    def scores(self, texts: list[set[int]]) -> np.ndarray:
        """For the term hashes of each text; one product for all of them."""
        place, known = self.place.__getitem__, self.known
        at = [sorted(map(place, known & t)) for t in texts]
        flat, row = np.array([i for x in at for i in x], int), np.repeat(np.arange(len(at)), [len(x) for x in at])
        f = self.vectors.shape[1]
        table = np.c_[self.weights, self.vectors, (self.vectors**2).sum(1)]
        sums = np.zeros((len(at), f + 2))
        np.add.at(sums, row, table[flat])
        z = self.bias + sums[:, 0] + 0.5 * ((sums[:, 1 : f + 1] ** 2).sum(1) - sums[:, f + 1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def paired(x: np.ndarray, y: np.ndarray, least: int, least_z: float) -> np.ndarray:
    """For each column of x, 0 or 1, its largest |z| with another: how far the share of label 1 among
    rows that hold both terms lies from what the terms' own shares lead to expect."""
    n, n1, p = len(y), float(y.sum()), y.mean()
    both, both1 = x.T @ x, x[y > 0].T @ x[y > 0]
    own = np.where(np.diag(both) > 0, np.diag(both1) / np.maximum(np.diag(both), 1), p)
    logit = np.log((own * n + p) / ((1 - own) * n + 1 - p))
    base = np.log(p / (1 - p))
    expected = 1 / (1 + np.exp(-np.clip(logit[:, None] + logit[None, :] - base, -30, 30)))
    z = (both1 - both * expected) / np.sqrt(np.maximum(both * expected * (1 - expected), 1.0))
    z[both < least] = 0
    np.fill_diagonal(z, 0)
    best = np.abs(z).max(1, initial=0)
    return np.where(best >= least_z, best, 0) if 0 < n1 < n else best * 0


def fit_toxicity(sample: DataFrame, stands_for: dict[int, float], *, inputs: int = 1024, least: int = 3, least_z: float = 5.0, common: int = 2048, pair_least: int = 20, pair_z: float = 7.0) -> FactorizationMachine | float:
    """sample: (id, text, label), of a bounded number of rows. A number is the score of every text.

    Inputs are the terms most associated with the label, alone or in a pair of the `common` most
    frequent ones: so terms that tell nothing alone can still interact.
    """
    if len(stands_for) < 2:
        return float(max(stands_for, default=0))

    def make():
        memo: dict = {}

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms = [np.array(sorted(term_hashes(t, memo)), np.int32) for t in text_bytes(batch["text"])]
            return pa.record_batch({"id": batch["id"], "label": batch["label"], "terms": pa.array(terms, pa.list_(pa.int32()))})

        return f

    got = map_rows(sample.withColumn("id", F.col("id").cast("string")), make, "id string, label int, terms array<int>").toArrow().sort_by("id")
    y = got["label"].to_numpy().astype(float)
    lists = got["terms"].combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(y)), sizes)
    seen1 = np.bincount(flat, weights=y[row], minlength=SPACE)
    seen = np.bincount(flat, minlength=SPACE)
    n1, n = y.sum(), len(y)
    if not 0 < n1 < n:
        return float(n1 > 0)
    share = seen / n
    z = (seen1 / n1 - (seen - seen1) / (n - n1)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / (n - n1)))
    z[(seen < least) | (np.abs(z) < least_z)] = 0  # else it is chance
    often = np.sort(np.argsort(-seen, kind="stable")[:common])
    at = np.full(SPACE, -1, np.int32)
    at[often] = np.arange(len(often))
    held = np.zeros((n, len(often)), np.float32)
    held[row[at[flat] >= 0], at[flat[at[flat] >= 0]]] = 1
    z = np.abs(z)
    z[often] = np.maximum(z[often], paired(held, y, pair_least, pair_z))
    chosen = np.sort(np.argsort(-z, kind="stable")[:inputs])
    chosen = chosen[z[chosen] != 0]
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    used = place[flat] >= 0
    x[row[used], place[flat[used]]] = 1
    return FactorizationMachine.fit(x, y, chosen, np.where(y > 0, stands_for.get(1, 1.0), stands_for.get(0, 1.0)))


def score_toxicity(docs: DataFrame, model: FactorizationMachine | float, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Adds score to the columns of keep (input column -> name)."""
    keep = keep or {}
    rows = docs.select(*[F.col(c).alias(name) for c, name in keep.items()], F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"] + ["score double"])

    def make():
        memo: dict = {}

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = text_bytes(batch["_text"])
            scores = np.full(len(texts), model) if isinstance(model, float) else model.scores([term_hashes(t, memo) for t in texts])
            return pa.record_batch({c: batch[c] for c in keep.values()} | {"score": pa.array(scores, pa.float64())})

        return f

    return map_rows(rows, make, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", id_bucket("doc_id", 5) == 0)
    sample, stands_for = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", id_bucket("doc_id", 5) != 0)
    scored = score_toxicity(docs, fit_toxicity(sample, stands_for), "text", {"doc_id": "doc_id", "held_out": "held_out"})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
