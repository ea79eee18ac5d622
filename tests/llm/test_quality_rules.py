"""Quality rules: figures against brute force, held-out accuracy, features against a plain loop, odd documents."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grainmill.llm import bytesops, quality_rules as rules, samples

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


@pytest.fixture(scope="module")
def model(more_docs, labels):
    keep = samples.remainder("id", 5) != 0
    return rules.train(samples.labelled(more_docs, labels, "quality", keep, rules.SAMPLE_ROWS))


@pytest.mark.parametrize("limit", [rules.PIECE, 40, 7])
def test_figures_match_brute_force(limit):
    rng = np.random.default_rng(1)
    texts = ["", "a", "a b c a b c", "x\nx\n\nx \r\nx", "a a a a", "é ü\x0b# é ü #   é\n", "   ", "y" * 90 + " " + "y" * 90]
    texts += ["".join(rng.choice(list("ab \n#é"), size=int(n))) for n in rng.integers(1, 300, 150)]
    texts += ["q" * 33 + "\n" + "q" * 34 + "\n" + "q" * 33, "one two three " * 60]
    found, _ = rules.figures(*bytesops.buffers(pa.array(texts)), limit)
    assert list(zip(*[found[n].tolist() for n in NAMES])) == [brute(t) for t in texts]


def test_query_figures_of_the_whole_table(more_docs, model):
    rows = rules.apply_rules(more_docs.select("doc_id", "text"), model).collect()
    assert len(rows) == more_docs.count()
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= rules.KEEP)


def test_held_out_accuracy(more_docs, labels, model):
    rows = rules.apply_rules(more_docs.select("doc_id", "text"), model).join(labels, "doc_id")
    held = rows.where(samples.held_out("doc_id", 5, 0)).toPandas()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    wins = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert wins > 0.95
    assert (good.score >= rules.KEEP).mean() > 0.98 and bad.kept.mean() < 0.1


def test_log_odds_match_a_plain_loop():
    rng = np.random.default_rng(2)
    model = rules.Model(rng.normal(size=(len(rules.FAMILIES), rules.BUCKETS)).astype(np.float32), 0.5, np.array([1.0, 0.0]))
    texts = ["Ab cd\tab", "x", "", "été, ÉTÉ! 12 12"]
    data, off = bytesops.buffers(pa.array(texts))
    got = rules.log_odds(model, data, off, rules.words(data, off))
    for text, odds in zip(texts, got):
        raw = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\x0b\x0c\r" else b for b in text.encode())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        one = lambda w: int(rules.words(*bytesops.buffers(pa.array([w]))).folded[0])
        hashes = [one(w) for w in re.findall(r"[^\x20\x09-\x0D]+", low)]
        pairs = [int(bytesops.mix(np.array([(a * 31 + b) % 2**64], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
        families = [[h % rules.BUCKETS for h in hashes], [h % rules.BUCKETS for h in pairs]]
        for n in rules.CHARS:
            grams = [int.from_bytes(raw[i : i + n], "big") for i in range(len(raw) - n + 1)]
            families.append([((g * 0x9E3779B97F4A7C15) % 2**64 >> 40) % rules.BUCKETS for g in grams])
        want = 0.5 + sum(np.mean([float(model.weights[f][b]) for b in own]) for f, own in enumerate(families) if own)
        assert odds == pytest.approx(want, abs=1e-9)


def test_odd_documents(odd, nothing, model, spark):
    clash = odd.withColumnRenamed("source", "N_Words").withColumnRenamed("lang", "_c0").withColumnRenamed("group", "_text")
    rows = rules.apply_rules(clash, model)
    assert [c for c in rows.columns if c.lower() == "n_words"] == ["n_words"] and rows.columns.count("score") == 1
    assert {"_c0", "_text", "id", "n_chars"} <= set(rows.columns)
    out = rows.toPandas().set_index("doc_id")
    assert len(out) == 11 and list(out.n_words[[1, 2, 3]]) == [0, 0, 0] and out.base_failed[[1, 2, 3]].all()
    assert out.loc[6].n_words == 40_000 and out.loc[6].base_failed and out.loc[7].n_words == 1
    assert out.loc[4].score.nunique() == 1 and out["_c0"].isna().sum() == 1
    assert rules.apply_rules(nothing, model).count() == 0
    flat = rules.train(samples.labelled(nothing, spark.createDataFrame([], "doc_id bigint, quality int"), "quality", samples.remainder("id", 5) != 0))
    assert rules.apply_rules(odd, flat).select("score").distinct().count() == 1
