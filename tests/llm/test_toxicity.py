import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import toxicity
from cohortspark.llm.toxicity import FOLDS, PENALTY, drop_toxic, fit, sample_labelled, score


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"w{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        words += [rng.choice(["nasty", "vileword" + rng.choice("abcdefgh") * 2])] * toxic + ["junkjunk"] * poor
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, documents):
    docs, labels = corpus(900, 1)
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    chain = fit(documents(docs), table.where("doc_id < 500"))
    truth = {d: (q, t) for d, q, t in labels}
    got = score(documents(docs), chain).where("doc_id >= 500").collect()
    right = lambda k, c: sum((r[c] >= 0.5) == bool(truth[r["doc_id"]][k]) for r in got) / len(got)
    assert right(0, "p_quality") >= 0.95 and right(1, "p_toxic") >= 0.97
    assert len(chain.models[1].coefficients) == len(chain.vocabulary) + 1


def test_edge_cases(spark, documents):
    docs, labels = corpus(200, 2)
    odd = documents(docs + [(1000, None), (1001, ""), (1002, "fine " * 20000), (1003, "nasty " * 5), (None, "nasty nasty"), (1003, "nasty " * 5)])
    table = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (8, *labels[8][1:])], "doc_id long, quality int, toxic int")
    kept = drop_toxic(spark, odd, table)
    assert kept.columns == odd.columns and {r["p_toxic"] for r in kept.select("p_toxic").collect()} == {"x"}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert {1000, 1001, 1002} <= set(ids) and 1003 not in ids and None not in ids
    assert drop_toxic(spark, odd, table.limit(0)).count() == odd.count()
    assert drop_toxic(spark, odd, table.withColumn("toxic", F.lit(0))).count() == odd.count()
    assert drop_toxic(spark, odd.limit(0), table).count() == 0


def fitted(x, y):
    """Logistic weights with a ridge penalty on all but the intercept, by Newton steps."""
    a, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0] + [PENALTY] * x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ b))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + ridge + 1e-12 * np.eye(len(b)), a.T @ (p - y) / len(a) + ridge @ b)
        b -= step * min(1.0, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    return lambda z: 1 / (1 + np.exp(-(b[0] + z @ b[1:])))


def test_chain_equals_a_plain_refit(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "ITERATIONS", 1000)
    monkeypatch.setattr(toxicity, "TOLERANCE", 1e-12)
    docs, labels = corpus(260, 3)
    rng = random.Random(9)
    # Noisy labels, so that the weights stay finite.
    labels = [(d, q ^ (rng.random() < 0.1), t ^ (rng.random() < 0.1)) for d, q, t in labels]
    table = spark.createDataFrame([(d, int(q), int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int")
    chain = fit(documents(docs), table, vocabulary=40)
    rows = sorted(sample_labelled(documents(docs), table, ("quality", "toxic"), 10_000).collect(), key=lambda r: r["doc"])
    place = {w: i for i, w in enumerate(chain.vocabulary)}
    x = np.zeros((len(rows), len(place)))
    for i, r in enumerate(rows):
        x[i, [place[t] for t in set(r["terms"]) if t in place]] = 1
    fold, quality, toxic = (np.array([r[c] for r in rows]) for c in ("fold", "quality", "toxic"))
    held_out = np.zeros(len(rows))
    for f in range(FOLDS):
        held_out[fold == f] = fitted(x[fold != f], quality[fold != f])(x[fold == f])
    first, second = fitted(x, quality), fitted(np.column_stack([x, held_out]), toxic)
    want = {r["doc"]: (p, q) for r, p, q in zip(rows, first(x), second(np.column_stack([x, first(x)])))}
    got = {r["doc_id"]: (r["p_quality"], r["p_toxic"]) for r in score(documents(docs), chain).collect()}
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=2e-3)
