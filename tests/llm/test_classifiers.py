"""Both classifiers: held-out accuracy, plain dense versions of their training, odd inputs."""

import math

import numpy as np
import pytest

from alamatika.llm import queries as Q
from alamatika.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def area(label, score):
    """Share of pairs of a 1 and a 0 that the scores order rightly."""
    ones, zeros = score[label == 1], score[label == 0]
    return ((ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2) if len(ones) and len(zeros) else 1


@pytest.mark.parametrize("name,column,least,threshold", [
    ("op4_toxicity", "toxic", 0.8, 0.7), ("op10_quality_classifier", "quality", 0.9, 0.3)])
def test_held_out(spark, name, column, least, threshold):
    scored = Q.QUERIES[name](spark, SF)
    rows = scored.join(Q.table(spark, SF, "labels").select("doc_id", column), "doc_id").toPandas()
    assert scored.count() == 1000
    held = rows[rows.held_out]
    assert area(held[column].to_numpy(), held.score.to_numpy()) > least
    assert ((rows.score >= threshold).astype(int) == rows.predicted).all()
    assert rows.score.between(0, 1).all()


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_inputs(spark, module, column):
    texts = [(k, "baik sekali rumah" if k % 2 else "buruk *** buruk", 0) for k in range(20)]
    texts += [(None, None, 0), (50, "", 0), (51, " \n", 0), (51, " \n", 0), (52, "kata " * 40_000, 0)]
    df = spark.createDataFrame(texts, "address_id long, raw_input string, score int")
    labels = spark.createDataFrame(
        [(k, 1 - k % 2 if column == "toxic" else k % 2) for k in range(20)] + [(1, None), (None, 1), (50, None), (3, None)],
        f"address_id long, {column} int")
    for some in (labels, labels.limit(0)):
        model = module.train(df, some)
        rows = module.score_requests(df, model).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
        assert [r["score"] for r in rows] == [r["score"] for r in module.score_requests(df, model).collect()]
    model = module.train(df, labels)
    good, bad = model.score("baik sekali rumah"), model.score("buruk *** buruk")
    assert (good < bad) if column == "toxic" else (good > bad)
    assert module.score_requests(df.limit(0), model).count() == 0


def test_reversed_gradient_keeps_the_risk_above_zero():
    """With a prior far too high the corrected part would fall below zero for good."""
    rng = np.random.default_rng(0)
    positive = (rng.random((40, 6)) < [0.9, 0.8, 0.5, 0.5, 0.1, 0.1]).astype(np.float32)
    unlabelled = (rng.random((400, 6)) < [0.1, 0.1, 0.5, 0.5, 0.5, 0.5]).astype(np.float32)
    rows = [np.flatnonzero(x) for x in np.concatenate([positive, unlabelled])]
    weights, bias = toxicity.fit(rows[:40], rows, 6, 0.5)
    assert np.isfinite(weights).all() and weights[0] > 0 > weights[4]
    assert (positive @ weights).mean() > (unlabelled @ weights).mean()


def test_unlabelled_texts_are_learnt_from(spark):
    """Words of toxic and of unlabelled texts alike, which no labelled negative holds."""
    texts = [(k, "rumah besar baru buruk" if k % 10 == 0 else "baik sekali" if k < 200 else f"rumah besar baru {k}") for k in range(2000)]
    df = spark.createDataFrame(texts + [(None, "rumah")], "address_id long, raw_input string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(200)] + [(300, None)], "address_id long, toxic int")
    model = toxicity.train(df, labels)
    assert model.score("rumah besar baru 1") < 0.5 < toxicity.TOXIC_FROM <= model.score("rumah besar baru buruk")
    assert toxicity.class_prior(labels) == 0.1
    assert toxicity.class_prior(labels.where("toxic = 1")) == toxicity.PRIOR


def test_long_training_texts_are_learnt_whole(spark):
    texts = [(k, " ".join(f"w{k}x{j}" for j in range(9000))) for k in range(2)]
    df = spark.createDataFrame(texts, "address_id long, raw_input string")
    model = quality.train(df, spark.createDataFrame([(0, 0), (1, 1)], "address_id long, quality int"))
    for _, text in texts:
        assert (model.weights[quality.shares(text)[0]] != 0).mean() > 0.9  # few share a bucket


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_risk_fit_equals_a_dense_loop(monkeypatch, prior):
    """Gradients row by row and feature by feature, through both branches."""
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rng = np.random.default_rng(5)
    positive = (rng.random((15, 5)) < [0.9, 0.7, 0.5, 0.2, 0.0]).astype(int)
    unlabelled = (rng.random((60, 5)) < [0.2, 0.3, 0.5, 0.6, 0.4]).astype(int)

    theta = [0.0] * 5 + [math.log(prior / (1 - prior))]
    first, second, reversed_steps = [0.0] * 6, [0.0] * 6, 0
    for step in range(1, 61):
        def mean(rows, sign):
            loss, slope = 0.0, [0.0] * 6
            for row in rows:
                x = [*row, 1]
                z = sum(t * v for t, v in zip(theta, x))
                loss += math.log1p(math.exp(-sign * z)) / len(rows)
                for j in range(6):
                    slope[j] += -sign * x[j] / (1 + math.exp(sign * z)) / len(rows)
            return loss, slope

        _, up = mean(positive, 1)
        lost, back = mean(positive, -1)
        whole, down = mean(unlabelled, -1)
        below = whole - prior * lost < 0
        reversed_steps += below
        for j in range(6):
            corrected = down[j] - prior * back[j]
            g = -corrected if below else prior * up[j] + corrected
            g += toxicity.DECAY * theta[j] if j < 5 else 0
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
        theta = [
            t - toxicity.RATE * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8)
            for t, a, b in zip(theta, first, second)
        ]
    weights, bias = toxicity.fit([np.flatnonzero(x) for x in positive], [np.flatnonzero(x) for x in unlabelled], 5, prior)
    assert np.allclose([*weights, bias], theta, atol=1e-6)
    assert 0 < reversed_steps < 60  # both branches were taken


def test_ftrl_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 12)
    rng = np.random.default_rng(6)
    learner, z, n = quality.Ftrl(), [0.0] * 13, [0.0] * 13

    def weight(j):
        if abs(z[j]) <= quality.L1:
            return 0.0
        return -(z[j] - math.copysign(quality.L1, z[j])) / ((quality.BETA + math.sqrt(n[j])) / quality.ALPHA + quality.L2)

    for k in range(200):
        buckets = np.flatnonzero(rng.random(12) < 0.4)
        values = rng.random(len(buckets))
        good, cost = int(rng.random() < 0.2 + 0.6 * (2 in buckets)), 0.5 + k % 3
        learner.learn(good, buckets, values, cost)
        row = [*zip(buckets.tolist(), values.tolist()), (12, 1.0)]
        old = {j: weight(j) for j, _ in row}
        p = 1 / (1 + math.exp(-sum(old[j] * x for j, x in row)))
        for j, x in row:
            g = cost * (p - good) * x
            sigma = (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / quality.ALPHA
            z[j] += g - sigma * old[j]
            n[j] += g * g
    model = learner.model()
    assert np.allclose(model.weights, [weight(j) for j in range(12)]) and abs(model.bias - weight(12)) < 1e-9
    assert model.weights[2] > 0


def test_size_of_the_toxicity_model_is_a_parameter(spark):
    texts = [f"kasar{k % 3} jorok umum{k}" if k % 2 else f"umum{k} biasa" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "address_id long, raw_input string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "address_id long, toxic int")
    words = lambda **size: set(toxicity.train(df, labels, **size).weights)
    assert words() == {"jorok", "kasar0", "kasar1", "kasar2"}
    assert words(max_features=1) == {"jorok"}
    assert words(min_texts=11) == {"jorok"}
    assert len(words(min_texts=1)) == 4 + 30
    assert len(words(min_texts=1, max_training=10)) < 34
