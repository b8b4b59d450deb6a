import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from aislekit.llm import ranked_search as S, repeated_phrases as R, run_detection as D
from aislekit.llm.queries import op11, op12, op13
from cases import edited, no_docs, odd_docs, odd_rows, prose, spread

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ---

def brute_runs(words):
    """(start, length, period) of all runs, period by period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            part = words[start:end]
            if end - start >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, end - start, q))
            i = j
    return sorted(out)


def local_runs(words):
    """Runs by the operator's tiles, stitched in plain Python."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([numbers[w] for w in words], np.uint64)
    found = defaultdict(list)
    for _, q, start, end in D.fragments(x, np.zeros(len(x), np.int64), np.array([0, len(x)])):
        found[q].append((start, end))
    out = []
    for q, parts in found.items():
        merged = []
        for start, end in sorted(parts):
            if merged and start <= merged[-1][1] - q:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        out += [(s, e - s, q) for s, e in merged if e - s >= max(24, 3 * q)]
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 12)), max_size=8))
def test_tiles_find_all_runs(parts):
    words = [w for block, times in parts for w in block * times][:900]
    assert local_runs(words) == brute_runs(words)


@pytest.mark.parametrize("period", [1, 7, 8, 15, 16, 31, 64, 100, 257])
@pytest.mark.parametrize("times", [3, 5.4])
def test_runs_at_any_place(period, times):
    rng = random.Random(period)
    block = [f"w{rng.randrange(10 ** 6)}" for _ in range(period)]
    run = (block * 40)[:max(24, int(period * times))]
    for before in (0, 1, 5, 13, 40):
        words = [f"a{i}" for i in range(before)] + run + [f"b{i}" for i in range(9)]
        assert local_runs(words) == brute_runs(words) == [(before, len(run), period)]


def test_z_function_and_single_values_agree():
    rng = random.Random(4)
    for _ in range(60):
        x = np.array([rng.randint(0, 1) for _ in range(60)], np.uint64)
        x[20:50] = np.tile(x[20:25], 6)
        at = rng.randint(5, 40)
        whole, single = D.Boundary(x, at, 3, 58, True), D.Boundary(x, at, 3, 58, False)
        for d in range(1, 58 - at):
            assert whole.forward(d) == single.forward(d) and whole.backward(d) == single.backward(d)


def expected_row(doc_id, text):
    words, h = words_of(text), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{l},{q}\n" for s, l, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_described_runs_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for i in range(80):
        p, n = rng.randint(1, 40), rng.randint(20, 300)
        tail = (prose(i, p).split() * 300)[:n]
        texts.append(" \t".join(prose(100 + i, rng.randint(0, 60)).split() + tail + prose(200 + i, rng.randint(0, 200)).split() + tail[:40]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {tuple(r) for r in D.describe_runs(docs, tails=True).collect()}
    assert found == {expected_row(i, t) for i, t in enumerate(texts)}
    assert {tuple(r) for r in D.describe_runs(spread(docs), tails=True).collect()} == found
    listed = defaultdict(list)
    for r in D.find_runs(docs).collect():
        listed[r["doc_id"]].append(tuple(r)[1:])
    assert {i: sorted(v) for i, v in listed.items()} == {i: r for i, t in enumerate(texts) if (r := brute_runs(words_of(t)))}


def test_runs_of_odd_and_empty_tables(spark):
    found = Counter(tuple(r) for r in D.describe_runs(odd_docs(spark), tails=True).collect())
    short = [r for r in odd_rows() if len(words_of(r[1])) < 1000]
    assert Counter(r for r in found.elements()) & Counter(expected_row(*r[:2]) for r in short) == Counter(expected_row(*r[:2]) for r in short)
    assert sum(found.values()) == len(odd_rows())
    assert D.describe_runs(no_docs(spark)).count() == 0


# --- repeated phrases ---

def brute_kept(texts, window):
    all_words = [words_of(t) for t in texts]
    places = Counter(tuple(w[i:i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for words in all_words:
        gone = {i + j for i in range(len(words) - window + 1) if places[tuple(words[i:i + window])] > 1 for j in range(window)}
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def phrase_texts():
    rng = random.Random(5)
    shared = [prose(900 + i, n) for i, n in enumerate((34, 35, 36, 50, 62, 63, 90, 200, 400))]
    texts = [prose(i, rng.randint(0, 150)) for i in range(30)]
    for i in range(60):
        texts.append(" ".join([prose(300 + i, rng.randint(0, 40)), rng.choice(shared), prose(400 + i, rng.randint(0, 40)), rng.choice(shared)]))
    base = prose(77, 300)
    texts += [base, base, edited(base, 1, 60), edited(base, 2, 37), edited(base, 3, 20), base.upper(), "same " * 400, "a b c " * 90, "\n".join(shared[7].split())]
    return texts


@pytest.mark.parametrize("window", [9, 35, 70])
def test_phrases_against_brute_force(spark, window):
    texts = phrase_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in R.without_repeats(docs, window=window).collect()}
    assert found == dict(enumerate(brute_kept(texts, window)))
    again = {r["doc_id"]: tuple(r)[1:] for r in R.without_repeats(spread(docs, 7), window=window).collect()}
    assert again == found


def test_a_hot_passage_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "CONTEXTS", 16)
    monkeypatch.setattr(R, "PHRASES", 8)
    hot = prose(1, 60)
    texts = [f"{prose(50 + i, 20)} {hot} {prose(500 + i % 9, 45)}" for i in range(120)] + [prose(9000 + i, 80) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in R.without_repeats(docs).collect()}
    assert found == dict(enumerate(brute_kept(texts, 35)))


def test_phrases_of_odd_and_empty_tables(spark):
    rows = odd_rows()
    expected = Counter((r[0], *k) for r, k in zip(rows, brute_kept([r[1] for r in rows], 35)))
    assert Counter(tuple(r) for r in R.without_repeats(odd_docs(spark)).collect()) == expected
    assert R.without_repeats(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        R.without_repeats(odd_docs(spark), window=71)


def test_contexts_depend_on_the_words_alone():
    """A window has one anchor and one place in its context's words, wherever it stands."""
    rng = random.Random(2)
    for _ in range(30):
        inner = [rng.randrange(4) for _ in range(60)]
        x = np.array([rng.randrange(4) for _ in range(rng.randint(0, 50))] + inner + [rng.randrange(4) for _ in range(20)], np.uint64)
        for y in (x, np.array(inner, np.uint64)):
            begin = len(x) - 80 if y is x else 0
            first, n, anchor = R.contexts(np.zeros(len(y), np.int64), R.Spans(y), 35)
            per_window = np.repeat(anchor, n)
            assert n.sum() == len(y) - 34 and n.max() <= 28 and (np.repeat(first, n) + np.concatenate([np.arange(m) for m in n]) == np.arange(len(y) - 34)).all()
            if y is x:
                seen = per_window[begin:begin + 26]
        assert (per_window == seen).all()


# --- ranked search ---

def brute_search(docs, items, k=10):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = [Counter(re.findall(pattern, (t or "").translate(_LOWER))) for _, t in docs]
    n_docs, total = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(re.findall(pattern, (t or "").translate(_LOWER)))
    out = set()
    for i, ws in asked.items():
        scored = []
        for (doc, _), t in zip(docs, terms):
            m = 10 + 90 * sum(t.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * t[w] // (1000 * t[w] + 8 * m)) for w in ws if w in t)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.add((i, rank, doc, -score))
    return out


def search_cases():
    rng = random.Random(8)
    docs = [(i, prose(i, rng.randint(0, 120))) for i in range(300)] + [(i, docs_text) for i, docs_text in ((400, "Alpha7 ALPHA7, alpha7!"), (401, "alpha7-alpha7"), (402, "é́ naïve Ünter")) for _ in (0, 1)]
    items = [(i, prose(5000 + i, rng.randint(1, 90))) for i in range(25)] + [(25, ""), (26, None), (27, "nowhere at all"), (28, "alpha7"), (28, "beta3"), (29, "É́ naïve"), (None, "gamma1")]
    return docs, items


@pytest.mark.parametrize("batch,block", [(1024, 8192), (4, 40)])
def test_search_against_brute_force(spark, monkeypatch, batch, block):
    monkeypatch.setattr(S, "BATCH_ITEMS", batch)
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    docs, items = search_cases()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = S.search(spread(d, 3), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {tuple(r) for r in found} == brute_search(docs, items) and len(found) == len(brute_search(docs, items))


def test_masks_stop_at_the_bound_with_the_same_result():
    rng = np.random.default_rng(1)
    for terms in (1, 5, 70):
        docs = 2000
        held = [np.flatnonzero(rng.random(docs) < p) for p in rng.uniform(0.01, 0.6, terms)]
        worth = [rng.integers(1, 1000, len(h)) * int(w) for h, w in zip(held, rng.integers(0, 5000, terms))]
        ids = rng.integers(0, 1500, docs)
        best, score = S.best_of_masks(held, worth, ids, 10)
        whole = np.zeros(docs, np.int64)
        for h, w in zip(held, worth):
            whole[h] += w
        order = [i for i in np.lexsort((ids, -whole)) if whole[i] > 0][:10]
        assert score.tolist() == whole[order].tolist() and ids[best].tolist() == ids[order].tolist()
        masks = S.presence_masks(held, docs)
        assert all(bool(masks[i, j // 64] >> np.uint64(j % 64) & np.uint64(1)) == (i in set(held[j].tolist())) for i in range(0, docs, 97) for j in range(terms))


def test_search_of_odd_and_empty_tables(spark):
    docs = [r[:2] for r in odd_rows()]
    items = spark.createDataFrame([(1, "alpha3 one WORD"), (2, None), (None, "id at all")], "item_id bigint, text string")
    found = S.search(odd_docs(spark), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in found.collect()} == brute_search(docs, [tuple(r) for r in items.collect()])
    assert S.search(no_docs(spark), items).count() == 0
    assert S.search(odd_docs(spark), items.limit(0)).count() == 0


def test_queries_give_the_agreed_columns(spark, small):
    assert op11(spark, small).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert op12(spark, small).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    found = op13(spark, small)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.schema["rank"].dataType.simpleString() == "int"
    assert found.groupBy("item_id").agg(F.max("rank").alias("m")).where("m > 10").count() == 0
