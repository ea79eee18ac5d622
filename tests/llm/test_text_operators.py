"""Personal data, near copies, language model, mixing and packing against brute force, and on odd inputs."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from grainmill.llm import bytesops, components, jaccard, lm, mixing, packing, pii

WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [w for w in WHITE.split((text or "").encode().translate(low)) if w]


# ---------------------------------------------------------------- personal data


def plain_patterns(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 12 <= len(digits) <= 19 and (sum(digits[-1::-2]) + doubled) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.fixture(scope="module")
def field():
    return pii.train()


PARTS = ["@", ".", "a", "b-", "1", "23", "255", "4111111111111111", " ", "-", "+1", "(", "é", "300", "_", "\n", "%", "1.2.3.4", "x@y.z"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=4))
def test_base_spans_match_the_patterns(field, texts):
    base, added = pii.find(field, *bytesops.buffers(pa.array(texts)))
    assert base == [plain_patterns(t) for t in texts]
    for spans, more, text in zip(base, added, texts):
        assert all(0 <= s < e <= len(text) for s, e, _ in more)
        assert not any(s < y and x < e for s, e, _ in more for x, y, _ in spans)


def test_the_field_finds_other_forms(field):
    texts = ["reach jane (at) example (dot) com now", "call 555-123-4567 now", "in 2019 the 12 teams won 3-1 twice", "grün " * 5 + "tel. 0171 2345678"]
    _, added = pii.find(field, *bytesops.buffers(pa.array(texts)))
    found = [[(pii.KINDS[k], t[s:e]) for s, e, k in a] for a, t in zip(added, texts)]
    assert found == [[("email", "jane (at) example (dot) com")], [("phone", "555-123-4567")], [], [("phone", "0171 2345678")]]


MARK = re.compile(r"\[(email|ip|card|phone):((?:[^][]|\[[^][]*\])*)\]")


@pytest.mark.parametrize("line", pii.LABELLED.strip().splitlines())
def test_labelled_rows_are_found_inside_plain_text(field, line):
    text = f"The long evening went by and nobody spoke. {MARK.sub(r'\2', line)} . Then the others came in from the garden"
    base, added = pii.find(field, *bytesops.buffers(pa.array([text])))
    found = [(k, *pii.trimmed(text.encode(), s, e)) for s, e, k in base[0] + added[0]]
    want = [(pii.KINDS.index(m[1]), m[2]) for m in MARK.finditer(line)]
    # A pattern may read the address alone, without its port or its net.
    assert len(found) == len(want) and all(k == j and text[s:e] in w and len(w) - e + s < 6 for (k, s, e), (j, w) in zip(found, want))


def test_numbers_across_the_seams_of_chains_are_whole(field):
    for before in range(pii.STRETCH - 6, pii.STRETCH + 3):
        text = "word 7 " * (before // 2) + "word " * (before % 2) + "call + 44 20 7946 0958 in the morning " + "word 7 " * 400
        _, added = pii.find(field, *bytesops.buffers(pa.array([text])))
        (whole,) = pii.find(field, *bytesops.buffers(pa.array(["word 7 " * 20 + "word " * (before % 2) + text[text.index("call") :]])))[1]
        at = text.index("call") - 140 - 5 * (before % 2)
        assert added[0] == [(s + at, e + at, k) for s, e, k in whole] and len(whole) == 1


def test_weights_of_words_are_sums_of_their_features(field):
    rows = ["Write to lee at example dot com, or CALL A b. Été 東京 x1 (at)", "", "one", "Qq, qq. at, At. q,, ., . é"] * 2
    data, off = bytesops.buffers(pa.array(rows))
    got = pii.emissions(field, data, off, *bytesops.word_spans(data, off))
    feats = [fs for r in rows for fs in pii.word_features(r.split())]
    want = [field.emission[[field.names.get(f, -1) for f in fs]].sum(0) for fs in feats]
    assert np.allclose(got, want)


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(4)
    emit, transition, lengths = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3)), np.array([1, 3, 4])
    best = pii.viterbi(emit, lengths, transition)
    for i, n in enumerate(lengths):
        score = lambda y: sum(emit[i, t, y[t]] for t in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(best[i, :n]) == max(itertools.product(range(3), repeat=int(n)), key=score)


def test_tag_and_redact_odd_documents(odd, nothing, field):
    rows = pii.tag(odd, field).toPandas().set_index("doc_id")
    assert len(rows) == 11 and rows.loc[8, "spans"] == "email:9:15,ip:16:23,phone:26:43"
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert (rows.base_sha256[rows.index.isin([1, 2, 3, 7])] == empty).all()
    texts = {r.doc_id: r.text for r in pii.redact(odd, field).collect()}
    assert texts[1] is None and texts[2] == "" and texts[8] == "été 12 ? <email> <ip> — <phone>"
    assert pii.redact(odd, field).columns == odd.columns
    assert pii.tag(nothing, field).count() == 0


# ---------------------------------------------------------------- near copies


def sets_of(rows):
    found = {}
    for i, t in rows:
        w = words(t)
        found[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return found


def links_of(sets):
    links = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            links[a].add(b)
            links[b].add(a)
    root = {}
    for i in sorted(sets):
        queue = [i]
        while queue:
            j = queue.pop()
            if j not in root:
                root[j] = root.get(i, i)
                queue += links[j]
    return links, root


def check_join(df, **options):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    links, root = links_of(sets_of(rows))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df, **options).collect()}
    assert got == {i: (root[i], len(links[i])) for i in links}


def test_join_matches_brute_force(spark, docs):
    check_join(docs.select("doc_id", "text"))


def test_large_groups_are_joined_in_blocks(spark):
    """120 near copies, 40 exact ones, and texts around the threshold, in blocks of 16 sets."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"u{i}"] + base[100:])) for i in range(120)]
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(1, 6)):
            text[rng.randrange(200)] = f"v{rng.random()}"
        rows.append((300 + i, " ".join(text)))
    rows += [(400 + i, " ".join(rng.choices(base, k=rng.randint(1, 9)))) for i in range(50)]
    check_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), block=16)


def test_join_of_odd_documents(odd, nothing):
    rows = {}
    for r in jaccard.join(odd).collect():
        rows.setdefault(r.doc_id, []).append((r.copy_of, r.class_id, r.n_links))
    assert rows[1] == [(1, 1, 2)] and rows[2] == [(1, 1, 2)] and rows[3] == [(1, 1, 2)]
    assert rows[4] == [(4, 4, 2)] * 2 and rows[5] == [(4, 4, 2)]  # the repeated row, and the same words in capitals
    assert rows[None] == [(None, None, 0)]
    assert jaccard.join(nothing).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = jaccard.bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.MOST_HASHES


def test_components_match_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        return x if parent[x] == x else root(parent[x])

    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


# ---------------------------------------------------------------- language model


def test_scores_match_brute_force(spark, docs):
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = {r.doc_id: r for r in lm.score(docs, learn).collect()}
    rows = [(r.doc_id, words(r.text) + [b"\0"]) for r in docs.collect()]
    taught = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count, pairs = {}, {}
    for t in taught:
        for a, b in zip([b"\0"] + t, t):
            count[b] = count.get(b, 0) + 1
            pairs[a, b] = pairs.get((a, b), 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        r = got[i]
        base = sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        low = sum(math.log10(max(pairs.get((a, b), 0) / max(count.get(a, 0), 1), count.get(b, 0) / n, 1 / (v + 1))) for a, b in zip([b"\0"] + t, t))
        assert r.score <= low + 1e-6  # a mixture is never above its largest part
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_mixture_prefers_what_explains_the_held_out_counts():
    import pandas as pd

    cell = lambda p: int(round(lm.GRAIN * math.log2(p)))
    rows = [(3, cell(0.5), cell(0.001), 90, 1000), (3, -9999, cell(0.01), 10, 1000), (9, -9999, cell(0.01), 50, 1000)]
    w = lm.learn_mixture(pd.DataFrame(rows, columns=["bucket", "pair", "word", "n", "types"])).weights
    assert abs(w[3, 0] - 0.9) < 0.02 and w[9, 1] > 0.95 and np.allclose(w.sum(1), 1, atol=1e-6)


def test_model_on_odd_documents(odd, nothing):
    rows = [r for r in lm.score(odd, F.col("doc_id") != 4).collect()]
    assert len(rows) == 11 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(nothing, F.lit(True)).count() == 0
    assert {r.score for r in lm.score(odd, F.lit(False)).collect()} == {0.0}


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
@settings(max_examples=100, deadline=None)
def test_narrow_numbers_round_trip(values):
    array = np.array(values, np.uint64)
    assert (lm.widen(lm.narrow(array), len(array)) == array).all()


# ---------------------------------------------------------------- mixing and packing


def test_budgets_shift_to_siblings_before_ancestors(spark):
    # Both sources of "a" cannot fill their language, which "b" in the same domain makes up for; "y" keeps its share.
    rows = [("x", "a", "s1", 10), ("x", "a", "s2", 20), ("x", "b", "s3", 1000), ("y", "a", "s4", 500), ("y", "a", "s5", 5)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint")
    got = {r.source: r.given for r in mixing.budgets(leaves, mixing.LEVELS, {}, 400.0, 1, 1.0).collect()}
    assert got == {"s1": 10, "s2": 20, "s3": 170, "s4": 195, "s5": 5}
    more = {r.source: r.given for r in mixing.budgets(leaves, mixing.LEVELS, {"source": {"s4": 0}}, 400.0, 2, 1.0).collect()}
    assert more == {"s1": 20, "s2": 40, "s3": 330, "s5": 10}


def test_mix_takes_prefixes_of_seeded_epochs(spark):
    import hashlib

    rows = [(i, " ".join("w" * (1 + i % 7)), "en", "src0") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    total = sum(1 + i % 7 for i in range(300))
    got = sorted((r.epoch, r.doc_id) for r in mixing.mix(df, {}, budget=total + 100.0, max_epochs=3, seed=9, details=True).collect())
    order = sorted(range(300), key=lambda i: hashlib.md5(f"9|1|{i}".encode()).hexdigest())
    want, used = [(0, i) for i in range(300)], 0
    for i in order:
        if used < 100:
            want.append((1, i))
        used += 1 + i % 7
    assert got == sorted(want)
    assert mixing.mix(df, {}, share=0.5, seed=9).columns == df.columns


def test_mix_of_odd_documents(odd, nothing):
    rows = mixing.mix(odd, {}, share=1.0, max_epochs=1)
    assert rows.columns == odd.columns and rows.where("doc_id = 6").count() == 1
    assert sorted(r.doc_id for r in rows.collect() if r.doc_id == 4) == [4, 4]
    assert mixing.mix(nothing, {}).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=60))
def test_assignment_fills_sequences(lengths):
    pieces = packing.assign(np.array(lengths, int), 64)
    total = sum(lengths)
    filled, at = {}, {}
    for row, start, n, s, offset in pieces:
        assert offset == filled.get(s, 0) and start == at.get(row, 0) and n > 0
        filled[s] = offset + n
        at[row] = start + n
    assert sum(at.values()) == total and len(filled) == -(-total // 64) and all(v <= 64 for v in filled.values())
    assert all(at.get(i, 0) == n for i, n in enumerate(lengths))


def test_assignment_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1000, 400)
    pieces = packing.assign(lengths, 1024)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + packing.cost(n)
    cost = np.array(list(cost.values()))
    assert cost.std() / cost.mean() < 0.15


def test_pieces_hold_the_tokenizers_ids(docs, odd, nothing):
    import public_tokenizers
    import tokenizers

    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    for df in (docs.where("doc_id < 60"), odd.where("doc_id <> 4")):
        ids = {r.doc_id: reference.encode(r.text or "", add_special_tokens=False).ids + [0] for r in df.collect()}
        rows = packing.pack(df, group_rows=32).toPandas()
        for doc_id, own in rows.sort_values("start").groupby("doc_id"):
            want, at = ids[doc_id], 0
            for r in own.itertuples():
                part = np.array(want[at : at + r.length], "<u4").tobytes()
                assert r.start == at and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(want)
                at += r.length
            assert at == len(want)
        assert set(rows.doc_id) == set(ids)
        rows = rows.sort_values(["sequence_id", "offset"])
        assert ((rows.groupby("sequence_id").length.cumsum() - rows.length) == rows.offset).all()
        assert rows.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(odd).where("doc_id = 4").count() == 2 and packing.pack(odd).where("doc_id IS NULL").count() == 1
    assert packing.pack(nothing).count() == 0


ADDED = ["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "page", " one", "'s", "é", "12", "<|ENDOFTEXT|>"]


def test_added_tokens_have_the_tokenizers_ids():
    import public_tokenizers
    import tokenizers

    reference, rng = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices(ADDED, k=rng.randint(0, 12)))
        assert packing.token_ids(packing.vocabulary_path(), text) == reference.encode(text, add_special_tokens=False).ids


def test_pieces_of_texts_with_added_tokens(spark):
    text = "page one <|endoftext|> page two"
    (row,) = packing.pack(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    want = [7700, 530, 220, 50256, 2443, 734, 0]
    assert (row.doc_tokens, row.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_an_id_with_two_texts_loses_no_link(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    near = lambda t: t + " end"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, None), (4, "x y"), (5, "x y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard.join(df).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (4, 4, 4, 0), (4, 4, 4, 1), (5, 4, 4, 1)]
    heads = sorted((r.doc_id, r.n) for r in jaccard.representatives(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert heads == [(1, 2), (4, 2)]
    seals = {r.seal for r in df.where("doc_id IN (1, 4)").select(F.xxhash64("text").alias("seal")).collect()}
    assert {r.seal for r in jaccard.representatives(df).collect()} == seals


def test_shapes_read_the_whole_word():
    assert pii.shape("a" * 70 + "@1") != pii.shape("a" * 70 + "@") and pii.shape("-" * 3 + "A1" * 40).endswith("Xd1")


def test_helper_columns_do_not_clash(odd, field):
    clash = odd.withColumnRenamed("lang", "_pii").withColumnRenamed("source", "N_Email")
    rows = pii.tag(clash, field)
    assert [c for c in rows.columns if c.lower() == "n_email"] == ["n_email"]
    want = sorted(str(r[0]) for r in clash.select("_pii").collect())
    assert sorted(str(r[0]) for r in rows.select("_pii").collect()) == want
    masked = pii.redact(clash, field)
    assert masked.columns == clash.columns and sorted(str(r[0]) for r in masked.select("_pii").collect()) == want
