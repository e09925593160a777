"""Plain versions of what the classifiers and the sharding compute."""

import collections
import math

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from skyledger.llm import common, language_id, quality, sharding, toxicity

WORDS = {"en": "the of and to house king water light road", "de": "der die und zu haus könig wasser licht weg", "fr": "le la et de maison roi eau lumière chemin"}


def sentences(rng, lang, n):
    return [" ".join(rng.choice(WORDS[lang].split(), 12)) for _ in range(n)]


def test_centroid_scores_by_hand(spark):
    """Cosines of a text's TF-IDF vector with every centroid, term by term."""
    rng = np.random.default_rng(2)
    train = [(i, t, lang) for lang in WORDS for i, t in enumerate(sentences(rng, lang, 30))]
    model = language_id.fit_language_id(spark.createDataFrame(train, "id long, t string, l string"), "t", "l", "id")
    texts = [t for lang in WORDS for t in sentences(rng, lang, 3)]
    got = language_id.identify_language(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), model, "t", {"id": "id"}).orderBy("id").collect()
    for text, r in zip(texts, got, strict=True):
        padded = f" {text} ".encode().translate(language_id.FOLD)
        bins = collections.Counter((int.from_bytes(padded[i : i + 3], "big") * 2654435761 % 2**32) >> 20 for i in range(len(padded) - 2))
        vector = {b: math.sqrt(c) * float(model.idf[b]) for b, c in bins.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        cosines = [sum(x * float(c[b]) for b, x in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r["lang_pred"] == model.languages[best] and r["score"] == pytest.approx(cosines[best], abs=1e-5)


def test_factorization_machine_is_the_sum_over_pairs(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30)], 8)) for _ in range(20)] + ["", "w1"]
    terms = sorted({h for t in texts for h in toxicity.term_hashes(t.encode(), {})})
    fm = toxicity.FactorizationMachine(np.array(terms), 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 4)))
    got = [r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), fm, "text", {"id": "id"}).orderBy("id").collect()]
    for text, score in zip(texts, got, strict=True):
        at = [terms.index(h) for h in toxicity.term_hashes(text.encode(), {})]
        z = 0.3 + sum(fm.weights[i] for i in at) + sum(float(fm.vectors[i] @ fm.vectors[j]) for a, i in enumerate(at) for j in at[a + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_terms_that_tell_nothing_alone(spark):
    """The label is 1 where both terms or neither stand: each alone is as frequent with either label."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1600):
        a, b = i % 2, i // 2 % 2
        noise = " ".join(f"n{x}" for x in rng.integers(0, 200, 10))
        rows.append((f"id{i}", f"{'insult ' if a else ''}{noise}{' groupname' if b else ''}", int(a == b)))
    df = spark.createDataFrame(rows, "id string, text string, label int")
    model = toxicity.fit_toxicity(df.limit(1200), {0: 1.0, 1: 1.0})
    got = toxicity.score_toxicity(df.subtract(df.limit(1200)), model, "text", {"label": "label"}).collect()
    assert sum((r["score"] >= 0.5) == r["label"] for r in got) >= 0.95 * len(got)


def test_compressed_sizes_by_hand(spark):
    rng = np.random.default_rng(5)
    good = ["".join(rng.choice(list("abcdefgh "), 900)) for _ in range(60)]
    bad = ["".join(rng.choice(list("stuvwxyz "), 900)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, int(i < 60)) for i, t in enumerate(good + bad)], "id long, text string, label int")
    model = quality.fit_quality(df, {0: 1.0, 1: 1.0})
    texts = [good[0], bad[0], "", None, "short", good[1] + bad[1]]
    got = [r["score"] for r in quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model, "text", {"id": "id"}).orderBy("id").collect()]
    for text, score in zip(texts, got, strict=True):
        data = (text or "").encode()
        sizes = [[len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(data[i : i + 512])) for i in range(0, max(len(data), 1), 512)] for d in model.dictionaries]
        g, b = map(sum, sizes)
        each = [(x - y) / (max(x, y) + 32) for x, y in zip(*sizes, strict=True)]
        x = [(g - b) / max(g, b), math.log(g / (len(data) + 8)), math.log(b / (len(data) + 8)), max(each), min(each)]
        z = model.coef[0] + sum(c * (v - m) / s for c, v, m, s in zip(model.coef[1:], x, model.mean, model.spread, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    assert got[0] > 0.9 > 0.1 > got[1] and got[2] == got[3]


@pytest.mark.parametrize("ids", ["null", "one"])
def test_samples_are_bounded_without_ids(spark, ids):
    lang = F.when(F.col("id") % 10 < 7, "en").when(F.col("id") % 10 < 9, "de")
    df = spark.range(6000).select(F.when(F.lit(ids == "one"), 1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), lang.alias("lang"))
    got = {r["lang"]: r["count"] for r in common.bounded_sample(df, "lang", ["doc_id", "text"], 100).groupBy("lang").count().collect()}
    assert got == {"en": 100, "de": 100}
    same = df.unionByName(df.select("doc_id", F.lit("one text").alias("text"), F.lit("en").alias("lang")))
    drawn = common.bounded_sample(same, "lang", ["doc_id", "text"], 100)
    assert drawn.where("lang = 'en'").count() == 100 and drawn.where("text = 'one text'").count() <= 1
    many = spark.range(5000).select("id", F.col("id").cast("string").alias("lang"))
    assert common.bounded_sample(many, "lang", ["id"], 100, most_rows=1000).count() == 1000
    assert common.bounded_sample(many, "lang", ["id"], 100, most_rows=5000).count() == 5000


def test_language_stage_without_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(None, t, lang) for lang in WORDS for t in sentences(rng, lang, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.language_stage(spark, docs, "").count() >= 170
    assert language_id.language_stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 180


def test_quality_and_toxicity_train_on_repeated_ids(spark):
    from skyledger.llm.labelled import labelled_sample

    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    sample, counts = labelled_sample(docs, labels, "toxic", F.lit(True))
    assert sorted(r["label"] for r in sample.collect()) == [0, 1] and set(counts) == {0, 1}


def test_no_group_is_cut_without_need(spark):
    """Groups that fit a shard lie in one: the fewest cut groups possible."""
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for g in range(400):
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i, f"text of group {g} " + "x" * int(g % 37)))
            i += 1
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    shards = collections.defaultdict(set)
    for r in got:
        shards[text[r["id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 2
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.08 * sum(sizes.values()) / 8


def test_sharding_of_rows_without_id(spark):
    rows = [(None, "the same text")] * 900 + [(5, "another one")] * 900 + [(None, None)] * 300
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(got) == 2100 and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.2 * sum(sizes.values()) / 8


def test_mixing_with_uneven_weights(spark, monkeypatch):
    """Buckets of the cut stay small whatever the weights; the sample is that of sorting all keys."""
    from skyledger.llm import mixing

    monkeypatch.setattr(mixing, "SMALL", 5)
    monkeypatch.setattr(mixing, "STEP", 5)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["ab" if i % 3 else "#1"] * int(rng.integers(1, 30))), "s") for i in range(3000)] + [(7, "again and again", "s")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim, sources = mixing.mix_plan(docs, share=0.3)
    got = {tuple(r) for r in slim.join(sources, "_source").select("id", "_size", "_key", mixing.copies()).collect()}
    budget, before, want = sources.first()["budget"], 0, set()
    order = collections.Counter((r["_key"], r["_id"], r["_size"], r["id"]) for r in slim.collect())
    by_key = collections.defaultdict(int)
    for (key, name, size, _), n in order.items():
        by_key[key, name] += size * n
    taken = set()
    for (key, name), size in sorted(by_key.items()):
        before += size
        if before - size / 2 <= budget:
            taken.add((key, name))
    want = {(i, size, key, int((key, name) in taken)) for key, name, size, i in order}
    assert got == want and sources.first()["level"] > 1
