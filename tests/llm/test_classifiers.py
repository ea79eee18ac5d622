"""Quality, toxicity and language: held-out accuracy and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm import bytesops, langid, quality, samples, toxicity


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores)) + 1
    ones = labels.sum()
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


@pytest.fixture(scope="module")
def field(more_docs, labels):
    return quality.train(samples.labelled(more_docs, labels, "quality", samples.remainder("id", 5) != 0))


@pytest.fixture(scope="module")
def model(more_docs, labels):
    return toxicity.train(samples.labelled(more_docs, labels, "toxic", samples.remainder("id", 3) != 1))


@pytest.fixture(scope="module")
def net(more_docs):
    return langid.train(*langid.sample(more_docs, samples.remainder("doc_id", 4) != 2, limit=300))


def held_out(scored, labels, label, modulus, value):
    rows = scored.join(labels, "doc_id").where(samples.held_out("doc_id", modulus, value)).toPandas()
    assert all(zlib.crc32(str(i).encode()) % modulus == value for i in rows.doc_id)
    return auc(rows.score.to_numpy(), rows[label].to_numpy())


def test_held_out_quality(more_docs, labels, field):
    assert held_out(quality.score(more_docs.select("doc_id", "text"), field), labels, "quality", 5, 0) > 0.98


def test_held_out_toxicity(more_docs, labels, model):
    assert held_out(toxicity.score(more_docs.select("doc_id", "text"), model), labels, "toxic", 3, 1) > 0.85


def test_long_runs_are_judged_to_their_end(model):
    ordinary = bytes(np.random.default_rng(2).integers(97, 123, 100_000, dtype=np.uint8))
    toxic = model.toxic[:60].replace(b" ", b"")
    for before in (0, 10_000, 50_000, 99_900, 100_000):
        data, off = bytesops.buffers(pa.array([ordinary[:before] + toxic + ordinary[before:], ordinary], pa.binary()))
        gaps = toxicity.document_gaps(model, data, off)
        assert gaps[0, 0] >= 10 > gaps[1, 0], before


def test_training_reads_long_runs_to_their_end():
    rng, parts, labels = np.random.default_rng(4), [], []
    for i in range(80):
        run = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
        parts.append(run[:2500] + b"verbotenestun" + run[2500:] if i % 2 else run)
        labels.append(i % 2)
    assert any(b"verbotene" in stretch for stretch in toxicity.distinctive(
        *[toxicity.Counter(p for p, y in zip(parts, labels) if y == k) for k in (1, 0)], 40, 40
    ))
    start, end, of = toxicity.pieces(np.array([0, 5, 1000]), np.array([5, 705, 1200]))
    for k, (s, e) in enumerate(((0, 5), (5, 705), (1000, 1200))):
        own = [(a, b) for a, b, o in zip(start, end, of) if o == k]
        assert own[0][0] == s and own[-1][1] == e and all(c < b for (_, b), (c, _) in zip(own, own[1:]))


def test_held_out_language(more_docs, net):
    rows = langid.identify(more_docs.select("doc_id", "text", "lang"), net).where(samples.held_out("doc_id", 4, 2)).toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_odd_documents_get_scores(odd, nothing, field, model, kind):
    run = (lambda df: quality.score(df, field)) if kind == "quality" else (lambda df: toxicity.score(df, model))
    rows = run(odd).toPandas()
    assert len(rows) == 11 and rows.score.between(0, 1).all()
    blank = rows[rows.doc_id.isin([1, 2, 3])].score
    assert blank.nunique() == 1
    assert sorted(rows.columns) == sorted(odd.columns)
    assert run(nothing).count() == 0


def test_language_of_odd_documents(odd, nothing, net):
    rows = langid.identify(odd, net).toPandas().set_index("doc_id")
    assert list(rows.lang_pred[rows.index.isin([1, 2, 3, 9])]) == ["und"] * 4
    assert (rows.lang_pred[rows.index.isin([4, 5, 6, 7, 8])] != "und").all()
    assert langid.identify(nothing, net).count() == 0
    untaught = langid.train(*langid.sample(nothing, F.lit(True)))
    assert set(r.lang_pred for r in langid.identify(odd, untaught).collect()) == {"und"}


def test_training_without_labels(nothing, labels, odd):
    none = samples.labelled(nothing, labels, "toxic", F.lit(True))
    assert toxicity.score(odd, toxicity.train(none)).select("score").distinct().count() == 1
    assert quality.score(odd, quality.train(none)).select("score").distinct().count() == 1


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    scores, transition, rows = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 9])
    good, expected = quality.marginals(scores, transition, rows)
    total = np.zeros((2, 2))
    for s, e in ((0, 4), (4, 9)):
        n = e - s
        weights, at, pairs = [], [], []
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            energy = sum(scores[s + t] * y[t] for t in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:]))
            weights.append(np.exp(energy))
            at.append(y)
            pairs.append([[sum((a, b) == (i, j) for a, b in zip(y, y[1:])) for j in (0, 1)] for i in (0, 1)])
        weights = np.array(weights) / sum(weights)
        assert np.allclose(good[s:e], weights @ np.array(at))
        total += np.tensordot(weights, np.array(pairs, float), 1)
    assert np.allclose(expected, total)


def test_network_reads_every_window():
    net = langid.Network(*(np.zeros(s, np.float32) for s in ((256, 8), (32, 36), (36,), (36, 2))), np.zeros(2, np.float32), ("a", "b"))
    data, off = bytesops.buffers(pa.array(["x" * 700, "", "y"]))
    x, owner, sizes = langid.windows(data, off)
    assert owner.tolist() == [0, 0, 0, 2] and sizes.tolist() == [256, 256, 188, 1]
    assert (x[2, :188] == ord("x")).all() and not x[2, 188:].any()
    assert langid.predict(net, data, off)[1].tolist() == [0.5, 0.0, 0.5]


def test_language_columns_do_not_clash(odd, net):
    clash = odd.withColumnRenamed("lang", "_langid").withColumnRenamed("score", "Score").withColumnRenamed("source", "__langid")
    rows = langid.identify(clash, net)
    assert [c for c in rows.columns if c.lower() == "score"] == ["score"]
    assert sorted(str(r[0]) for r in rows.select("_langid").collect()) == sorted(str(r[0]) for r in clash.select("_langid").collect())
