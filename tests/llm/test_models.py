import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislekit.llm import lm, pii, toxicity
from cases import no_docs, odd_docs, odd_rows, spread

SF = "/root/testdata/sf0.01"

# ---- toxicity ---------------------------------------------------------------------------


def auc(score, label):
    score, label = np.array(score), np.array(label)
    good = score[label == 0]
    return np.mean([(s > good).mean() + (s == good).mean() / 2 for s in score[label == 1]])


def brute_features(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {("1", w) for w in words} | {("2", a, b) for a, b in zip(words, words[1:])} | {("3", a, b) for a, b in zip(words, words[2:])}


def test_features_are_ngrams_and_skip_grams():
    texts = [r[1] for r in odd_rows()] + ["a b a b", "b a", "a x b", "stop. Stop, stop!"]
    rows, slots = toxicity.features(pa.array(texts))
    counts = np.bincount(rows, minlength=len(texts))
    assert counts.tolist() == [len(brute_features(t)) for t in texts]
    sets = [set(slots[rows == i].tolist()) for i in range(len(texts))]
    brute = [brute_features(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(brute[i] & brute[j])


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert 0 < len(model.slots) < 5000  # compact
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert auc([r["score"] for r in held], [r["toxic"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.01


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(15)] + [(None, 1, "x"), (3, None, "x"), (3, 1, "y")], "doc_id bigint, toxic int, t string")
    model = toxicity.train(odd_docs(spark), labels)
    rows = toxicity.score(odd_docs(spark), model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.clean(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    untrained = toxicity.train(no_docs(spark), labels)
    assert toxicity.score(no_docs(spark), untrained).count() == 0
    assert all(r["score"] < 1e-9 for r in toxicity.score(odd_docs(spark), untrained).collect())


# ---- personal data ----------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    def sound(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [(m.start(), m.end(), 0) for m in _EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and sound(digits(m))]
    out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_against_plain_regular_expressions():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@@+- ()ab%_é") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_patterns_take_linear_time_on_long_runs():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 1000 + "+" * 1000) == []


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"), steps=160)


def test_the_model_finds_held_out_spans_alone(spark, tagger, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 5000").select("text").collect()]
    known = [set(brute_spans(t)) for t in texts]
    monkeypatch.setattr(pii, "base_spans", lambda text: [])
    found = [set(s) for _, s in pii.find_spans(texts, tagger)]
    total = sum(map(len, known))
    assert sum(len(a & b) for a, b in zip(known, found)) > 0.4 * total
    assert sum(len(b - a) for a, b in zip(known, found)) < 0.05 * total


def test_base_spans_stay_and_texts_are_masked(spark, tagger):
    rows = pii.personal_data(odd_docs(spark), tagger).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] or "" for r in odd_rows() if r[0] is not None}
    for r in rows:
        if r["doc_id"] is None:
            continue
        base = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert set(filter(None, pii.named(base).split(","))) <= set(r["spans"].split(","))
    masked = {r["doc_id"]: r["text"] for r in pii.masked(odd_docs(spark), tagger).collect()}
    assert "[EMAIL]" in masked[15] and "[PHONE]" in masked[15] and "[IP]" in masked[15] and "605" not in masked[15]
    assert masked[0] is None and masked[7] == texts[7]
    assert pii.personal_data(no_docs(spark), pii.train(no_docs(spark))).count() == 0


def test_overlapping_windows_cover_and_agree(tagger):
    for gap in range(0, 130, 7):
        text = "z" * gap + " name.one@mail.example.com " + "y" * 100
        (base, spans), = pii.find_spans([text], tagger)
        assert spans == base and len(base) == 1
        codes = pii.classes(text)
        starts = pii.windows(codes)
        assert any(s <= base[0][0] and base[0][1] <= s + pii.WIDTH for s in starts)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    codes, tags = rng.integers(0, pii._CLASSES, (3, 12)), rng.integers(0, pii.TAGS, (3, 12))
    p = {k: v.astype(np.float64) for k, v in pii._start_params(rng).items()}

    def loss(p):
        left, tl = pii._lstm(p, "l", codes, True)
        right, tr = pii._lstm(p, "r", codes[:, ::-1], True)
        states = np.concatenate([left, right[:, ::-1]], 2).astype(np.float64)
        return pii._crf_gradient(p, states @ p["out"] + p["bias"], tags), tl, states

    (value, emit, trans, _), tape, states = loss(p)
    down = (emit @ p["out"].T)[:, :, :pii.HIDDEN]
    gx, gh = pii._lstm_gradient(p, "l", codes, tape, down)
    for name, gradient, at in (("trans", trans, (2, 3)), ("hl", gh, (1, 5)), ("xl", gx, (int(codes[0, 3]), 2)), ("out", np.einsum("nth,ntk->hk", states, emit), (4, 1))):
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-3
        more = loss(moved)[0][0]
        moved[name][at] -= 2e-3
        less = loss(moved)[0][0]
        assert abs((more - less) / 2e-3 - gradient[at]) < 2e-3 + 0.05 * abs(gradient[at])


# ---- language model ---------------------------------------------------------------------

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in rows]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    below = math.log10(n + 0.1 * (v + 1))
    return [(k, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10(counts[w] + 0.1) - below for w in ws)) for (k, _), h, ws in zip(rows, held, words)]


def same(found, expected):
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=str)
    expected = sorted(expected, key=str)
    return len(found) == len(expected) and all(a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-6) for a, b in zip(found, expected))


@pytest.mark.parametrize("heavy", [1 << 18, 40])
def test_scores_against_brute_force(spark, small, monkeypatch, heavy):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = lm.score_texts(docs).collect()
    assert same(found, brute_base([(r["doc_id"], r["text"]) for r in docs.collect()]))
    held = [r for r in found if r["held_out"]]
    assert all(r["score"] < 0 for r in found)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(spark):
    assert same(lm.score_texts(odd_docs(spark)).collect(), brute_base([(r[0], r[1]) for r in odd_rows()]))
    assert lm.score_texts(no_docs(spark)).count() == 0


def test_class_probabilities_sum_to_one():
    model = lm.Bilinear(np.full(lm.CLASSES, 1 / lm.CLASSES))
    context = np.tile(np.array([[3, 5, lm.CLASSES, 0, 9]]), (lm.CLASSES, 1))
    assert abs((10 ** model.log10(np.arange(lm.CLASSES), context)).sum() - 1) < 1e-5


def test_learning_raises_the_probability_of_a_pattern():
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    model, rng = lm.Bilinear(noise), np.random.default_rng(0)
    classes = np.tile([1, 2, 3, 4], 600)
    context = np.stack([np.roll(classes, d) for d in range(1, lm.CONTEXT + 1)], 1)
    before = model.log10(classes, context).mean()
    for _ in range(40):
        model.train(classes, context, 0.2, rng)
    assert model.log10(classes, context).mean() > before + 1


def test_scores_are_the_same_for_rows_spread_otherwise(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(lm, "SHARD", 60)  # several shards
    a, b, c = ({r["doc_id"]: r for r in lm.score_texts(spread(docs, n)).collect()} for n in (1, 3, 8))
    for other in (b, c):
        # the model is the same bit by bit; products in single precision round by the size of a batch
        assert max(abs(a[k][s] - other[k][s]) / max(1, abs(a[k][s])) for k in a for s in ("base_score", "score")) < 1e-6


def test_scores_against_a_plain_computation(spark, small):
    """Class by class and word by word, with the model that the operator trains."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    known = docs.where(lm.remainder("doc_id", 10) != 0).select(F.col("text").alias("t"), F.xxhash64(F.lit(lm.SEED), F.col("doc_id").alias("k"), F.col("text").alias("t")).alias("mark"))
    counts = lm.word_counts(known)
    vocabulary = lm.Vocabulary(counts)
    model = lm._trained(known, vocabulary)
    count = {r["h"]: r["c"] for r in counts.collect()}
    found = {r["doc_id"]: r["score"] for r in lm.score_texts(docs).collect()}
    for r in docs.collect():
        words, h, ending = lm.tokens(pa.array([r["text"]]))
        classes = [*vocabulary.classes(h, ending).tolist(), 0]
        total = 0.0
        for i, c in enumerate(classes):
            q = sum(model.before[classes[i - d] if i >= d else lm.CLASSES].astype(float) * model.weight[d - 1] for d in range(1, lm.CONTEXT + 1))
            scores = model.after.astype(float) @ q + model.bias
            total += (scores[c] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / np.log(10)
            if c > lm.SINGLE:
                e = c - 1 - lm.SINGLE
                total += np.log10(count.get(int(h[i]), 0) + 0.1) - np.log10(vocabulary.class_tokens[e] + 0.1 * (vocabulary.class_words[e] + 1))
        assert abs(found[r["doc_id"]] - total) < 1e-3


@pytest.mark.parametrize("length", [30, 60, 96, 120, 300])
def test_spans_are_found_whole_wherever_windows_cut_them(monkeypatch, length):
    """A tagger that is sure of every character of the span."""
    letters = pii.classes("z@.").tolist()

    def emissions(p, x):
        out = np.zeros((*x.shape, pii.TAGS), np.float32)
        inside = np.isin(x, letters)
        begin = inside.copy()
        begin[:, 1:] &= ~inside[:, :-1]
        out[..., 0] = np.where(inside, -20, 20)
        out[..., 1], out[..., 2] = np.where(begin, 20, -20), np.where(inside & ~begin, 20, -20)
        return out

    monkeypatch.setattr(pii, "emissions", emissions)
    p = {"trans": np.zeros((pii.TAGS, pii.TAGS), np.float32), "first": np.zeros(pii.TAGS, np.float32)}
    span = "z" * (length - 8) + "@" + "z" * 3 + "." + "zzz"
    monkeypatch.setattr(pii, "base_spans", lambda text: [])
    fillers = [c for c in "(),;" if pii.classes(c)[0] not in letters]
    for offset in range(0, 150, 1 if length < 100 else 7):
        text = fillers[0] * offset + span + fillers[0] * 130
        (_, found), = pii.find_spans([text], p)
        assert found == [(offset, offset + length, 0)], offset


def test_chains_of_pieces():
    """A chain is closed by ends that no edge cuts."""
    whole, left, right, middle = (0, 5, 0, 0.9, False, False), (10, 96, 1, 0.8, False, True), (48, 120, 1, 1.0, True, False), (48, 144, 2, 1.0, True, True)
    assert pii.stitched([whole, left, right, middle]) == [(0, 5, 0, 0.9), (10, 120, 1, pytest.approx((0.8 * 86 + 72) / 158))]
    assert pii.stitched([left]) == [] and pii.stitched([right]) == [] and pii.stitched([]) == []


def test_weights_against_a_plain_ftrl_loop():
    rng = np.random.default_rng(2)
    examples = [np.unique(rng.integers(0, 40, 6)) for _ in range(120)]
    labels = np.array([int(3 in e or 7 in e) for e in examples])
    slots, weights, bias = toxicity.fit(examples, labels, epochs=3)
    z, n, l1 = Counter(), Counter(), toxicity.L1_NOISE * 120 ** 0.5

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    bz = bn = 0.0
    for _ in range(3):
        for e, y in zip(examples, labels.tolist()):
            w = {i: weight(i) for i in e.tolist()}
            b = -bz / ((toxicity.BETA + bn ** 0.5) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for i, x in w.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * x
                n[i] += g * g
            bz += g - ((bn + g * g) ** 0.5 - bn ** 0.5) / toxicity.ALPHA * b
            bn += g * g
    assert slots.tolist() == sorted(i for i in z if abs(z[i]) > l1)
    assert np.allclose(weights, [weight(i) for i in slots.tolist()]) and abs(bias + bz / ((toxicity.BETA + bn ** 0.5) / toxicity.ALPHA)) < 1e-9


def test_a_key_of_a_third_of_all_rows_is_one_example(spark):
    rows = [(i if i % 3 else 1, f"fine words {i}" if i % 2 else f"awful words {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(300)], "doc_id bigint, bad boolean").select("doc_id", F.col("bad").cast("int").alias("toxic"))
    a, b = (toxicity.train(d, labels) for d in (docs, spread(docs.union(docs), 7)))
    assert a.slots.tolist() == b.slots.tolist() and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_python_workers_give_memory_back_after_a_task(monkeypatch):
    from types import SimpleNamespace

    from aislekit.llm import base

    done = []
    monkeypatch.setattr(base, "release", lambda: done.append("released"), raising=False)
    conf = SimpleNamespace(get=lambda key: str(base.BATCH_ROWS))
    df = SimpleNamespace(sparkSession=SimpleNamespace(conf=conf), mapInArrow=lambda run, schema: run)
    run = base.map_arrow(df, lambda batches: (b + 1 for b in batches), "x int")
    assert list(run(iter([1, 2]))) == [2, 3] and done == ["released"]


def test_scores_of_all_classes_are_held_for_few_tokens_at_once():
    import tracemalloc

    rng = np.random.default_rng(8)
    model = lm.Bilinear(np.full(lm.CLASSES, 1 / lm.CLASSES))
    classes, context = rng.integers(0, lm.CLASSES, 5000), rng.integers(0, lm.CLASSES + 1, (5000, lm.CONTEXT))
    model.train(classes, context, 0.2, rng)
    tracemalloc.start()
    got = model.log10(classes, context)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3e6
    q = sum(model.before[context[:, d]].astype(float) * model.weight[d] for d in range(lm.CONTEXT))
    scores = q @ model.after.T.astype(float) + model.bias
    expected = scores[np.arange(5000), classes] - np.log(np.exp(scores).sum(1))
    assert np.allclose(got, expected / np.log(10), atol=1e-5)
    model.bias += 70  # too far for plain exponentials
    assert np.allclose(model.log10(classes, context), got, atol=1e-4)
    assert model.log10(classes[:0], context[:0]).tolist() == []
