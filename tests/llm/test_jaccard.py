"""The near-dedup stage of the pipeline against all pairs by brute force."""

import numpy as np
import pytest

from skyledger.llm import simhash

ROW = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()}


def brute_classes(texts):
    """The smallest number in the class of each text."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if of[i] != of[j] and both >= 0.8 * either:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def kept(spark, rows):
    return sorted(tuple(r) for r in simhash.dedup_stage(spark, spark.createDataFrame(rows, ROW), "").collect())


def changed(rng, words, n):
    out = list(words)
    for at in rng.choice(len(words) // 6, n, replace=False) * 6 + 3:
        out[at] = f"x{rng.integers(1 << 60)}"
    return out


def chains(rng):
    """One large group of close copies, and chains whose links lie at 0.8 to 0.85 or just below."""
    base = [f"w{j}" for j in range(204)]
    texts = [changed(rng, base, 2) for _ in range(100)]
    for start in range(0, 100, 10):
        last = texts[start]
        for step in (3, 4, 5):
            last = changed(rng, last, step)
            texts.append(last)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_dedup_stage_chains_in_a_large_group(spark):
    texts = chains(np.random.default_rng(3))
    of = brute_classes(texts)
    assert kept(spark, list(enumerate(texts))) == [(i, t) for i, t in enumerate(texts) if of[i] == i]


@pytest.mark.parametrize("small, stars", [(2, 1), (5, 3)])
def test_similar_classes_by_stars(spark, small, stars):
    from skyledger.llm import jaccard

    texts = chains(np.random.default_rng(4))
    of = brute_classes(texts)
    got = {r["id"]: r["component"] for r in jaccard.similar_classes(spark.createDataFrame(list(enumerate(texts)), ROW), "doc_id", "text", small=small, stars=stars).collect()}
    assert all((got[i] == got[j]) == (of[i] == of[j]) for i in range(len(texts)) for j in range(i))


def test_dedup_stage_finds_all_pairs_just_over_the_bound(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(150):
        words = [f"p{k}w{j}" for j in range(204)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed(rng, words, 4)))]
    of = brute_classes([t for _, t in rows[:20]])
    assert of == [i - i % 2 for i in range(20)]
    assert [i for i, _ in kept(spark, rows)] == list(range(0, 300, 2))


def test_dedup_stage_keeps_texts_of_equal_frequent_lines(spark):
    line = " ".join(f"line{j}" for j in range(9))
    rows = [(k, " ".join([line] * 20 + [f"own{k}x{j}" for j in range(20)])) for k in range(30)]
    assert kept(spark, rows) == rows


def test_dedup_stage_drops_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(60)) for x in "abc")
    assert kept(spark, [(1, a), (1, b), (2, a), (2, c), (1, a), (3, b)]) == [(1, a), (1, b), (2, c)]
