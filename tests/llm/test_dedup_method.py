"""The near-dedup stage goes by its fingerprints: their links come first, and bind what the exact test lets through."""

import numpy as np
import pytest

from skyledger.llm import jaccard, simhash
from tests.llm.test_jaccard import ROW, brute_classes, changed, kept, shingles


def texts_of(rng):
    """Near copies, pairs at about 0.82, texts of one fingerprint that are not alike, and others."""
    line, texts = " ".join(f"line{j}" for j in range(9)), []
    for k in range(12):
        words = [f"p{k}w{j}" for j in range(204)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(changed(rng, words, 4))]
    texts += [" ".join([line] * 20 + [f"own{k}x{j}" for j in range(20)]) for k in range(6)]
    return texts + [" ".join(f"z{k}y{j}" for j in range(90)) for k in range(10)]


def alike(a, b):
    return len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))


def fingerprints_linked(texts, radius):
    fps = [simhash.fingerprint(t.encode(), 5)[0] for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= radius}


def classes(n, pairs):
    of = list(range(n))
    for i, j in pairs:
        low, high = sorted((of[i], of[j]))
        of = [low if x == high else x for x in of]
    return of


def test_stage_binds_by_links_of_fingerprints(spark, monkeypatch):
    texts = texts_of(np.random.default_rng(6))
    of, calls, found = brute_classes(texts), [], {}
    for name in ("bit_statistics", "allocate", "signatures", "verify"):
        monkeypatch.setattr(simhash, name, lambda *a, f=getattr(simhash, name), n=name, **k: calls.append(n) or f(*a, **k))

    def passing(pairs, nodes, *args, f=jaccard.passing):
        passed = f(pairs, nodes, *args)
        ids = {r["node"]: r["id"] for r in nodes.collect()}
        found[args[-1]] = [{tuple(sorted((ids[r["u"]], ids[r["v"]]))) for r in x.collect()} for x in (pairs, passed)]
        return passed

    monkeypatch.setattr(jaccard, "passing", passing)
    assert kept(spark, list(enumerate(texts))) == [(i, t) for i, t in enumerate(texts) if of[i] == i]
    assert calls == ["bit_statistics", "allocate", "signatures", "verify"]
    want = fingerprints_linked(texts, 3)
    met, passed = found["links"]
    assert met <= want and classes(len(texts), met) == classes(len(texts), want)
    assert passed == {(i, j) for i, j in met if alike(texts[i], texts[j])}
    assert sum((3 * k, 3 * k + 1) in passed for k in range(12)) >= 9  # near copies
    assert {x for i, j in met - passed if i >= 36 for x in (i, j)} == set(range(36, 42))  # one fingerprint, unlike texts


@pytest.mark.parametrize("radius, guard", [(0, None), (3, None), (10, 50)])
def test_classes_whatever_the_links(spark, radius, guard):
    texts = texts_of(np.random.default_rng(7))
    of = brute_classes(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), ROW)
    got = {r["id"]: r["component"] for r in jaccard.similar_classes(rows, "doc_id", "text", first=simhash.FirstLinks(radius, guard)).collect()}
    assert all((got[i] == got[j]) == (of[i] == of[j]) for i in range(len(texts)) for j in range(i))
