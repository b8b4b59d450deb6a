import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislekit.llm import components as G, fingerprints as P, parity_join as J, pivots as V
from cases import edited, no_docs, odd_docs, odd_rows, prose, spread

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def near_docs():
    rng = random.Random(9)
    texts = [prose(1000 + i, rng.randint(1, 250)) for i in range(60)]
    for i in range(24):
        base = prose(i, (3, 5, 9, 17, 40, 90, 160, 400)[i % 8])
        texts += [base, base]
        texts += [edited(base, s, every) for s, every in ((1, 25), (2, 50), (3, 80), (4, 120), (5, 30))]
    return texts


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_similar_texts_against_all_pairs(spark, k, percent):
    texts = near_docs()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [shingle_set(t, k) for t in texts]
    roots = brute_components(sets, percent)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_texts(docs, words=k, percent=percent).collect()}
    assert found == {i: (len(s), least[roots[i]] if s else i) for i, s in enumerate(sets)}


def test_linked_rows_share_as_many_words_as_told():
    rng = random.Random(6)
    for percent in (80, 85):
        layouts = J.Layouts(percent, 1 << 20)
        for n in (3, 12, 40, 90, 200, 500):
            a = {rng.getrandbits(63) for _ in range(n)}
            differ = int(layouts.differ(n, n)) // 2
            b = set(rng.sample(sorted(a), n - differ)) | {rng.getrandbits(63) for _ in range(differ)}
            sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
            rows, hashes, size = np.repeat([0, 1], [len(x) for x in sets]), np.concatenate(sets), np.array([len(x) for x in sets])
            band = np.full(2, layouts.band(size[:1])[0])
            at, key = J._block_words(layouts, band, rows, hashes, size)
            common = len(set(key[at == 0].tolist()) & set(key[at == 1].tolist()))
            assert common >= J.shared_words(layouts, band, rows, hashes, size).max() >= 1


@pytest.mark.parametrize("named", [True, False])
def test_one_of_each_group_stays(spark, named):
    base = prose(1, 90)
    texts = [base, edited(base, 1, 60), edited(base, 2, 80), base, prose(2, 50), None, "", "", prose(3, 4)]
    rows = [(7 if named else None, t, i) for i, t in enumerate(texts)] + [(9, base, 20), (9, base, 21), (3, prose(2, 50), 22)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __mark int")
    kept = J.without_copies(docs)
    assert kept.columns == docs.columns
    found = [tuple(r) for r in kept.collect()]
    # one of the near copies, which all have one id (or none: then that with an id), one of the equal texts, and what has no words
    near = [r for r in found if r[1] and base.split()[5] in r[1].split()[5:6]]
    assert len(near) == 1 and near[0][0] == (7 if named else 9)
    assert [r for r in found if r[1] == prose(2, 50)] == [(3, prose(2, 50), 22)]
    assert len(found) == 1 + 1 + 3 + 1
    assert J.without_copies(no_docs(spark)).count() == 0


def test_long_groups_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 16)
    base = prose(77, 150)
    texts = [edited(base, s, (12, 40, 200)[s % 3]) for s in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    roots = brute_components([shingle_set(t, 4) for t in texts], 85)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert {r["doc_id"]: r["component_id"] for r in J.similar_texts(docs).collect()} == {i: least[r] for i, r in enumerate(roots)}


def family(n: int) -> list[str]:
    """Copies of a text with one word in a place of its own, or two, changed: many are near ones of many and linked with few."""
    rng = random.Random(n)
    base = prose(88, 146).split(" ")
    texts = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(146), 1 if i % 4 == 0 else 2):
            words[at] = f"new{i}x{at}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("part,shingles,share", [(1024, 1 << 20, 0.5), (16, 1 << 11, 0.5), (32, 1 << 12, 0.0), (32, 1 << 12, 1.1)])
def test_links_of_a_family_whose_copies_are_near_but_not_linked(spark, monkeypatch, part, shingles, share):
    monkeypatch.setattr(J, "PART", part)
    monkeypatch.setattr(J, "PART_SHINGLES", shingles)
    monkeypatch.setattr(J, "FAMILY", share)
    texts = family(60) + [edited(prose(89, 146), s, (30, 60, 200)[s % 3]) for s in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    roots = brute_components([shingle_set(t, 4) for t in texts], 85)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert {r["doc_id"]: r["component_id"] for r in J.similar_texts(docs).collect()} == {i: least[r] for i, r in enumerate(roots)}


@pytest.mark.parametrize("n", [100, 200])
def test_members_leave_a_family_not_their_pairs(spark, n):
    """All sketches are near and no components equal: before, n * (n - 1) / 2 pairs left the task, for each key."""
    rows = [(7, i, i, [1, 2, 3], 146, bytes(64)) for i in range(n)]
    members = spark.createDataFrame(rows, "family bigint, node bigint, component bigint, keys array<bigint>, n bigint, brief binary")
    assert sorted(r["node"] for r in J._near_ones(members, J.Layouts(85, 1000)).collect()) == list(range(n))


def test_members_of_many_parts_meet_again_once_each(spark, monkeypatch):
    """Before, each of the 60 left every pair of parts that showed it, and was taken apart by its keys each time."""
    monkeypatch.setattr(J, "PART", 2)
    rows = [(key, i, i if i < 30 else 99) for i in range(60) for key in (7, 9, 11)]
    members = J._families(spark.createDataFrame(rows, "key bigint, node bigint, component bigint"), 0.5)
    brief = spark.createDataFrame([(i, 146, bytes(64)) for i in range(60)], "node bigint, n bigint, brief binary")
    near = J._near_ones(members.join(brief, "node"), J.Layouts(85, 1000))
    assert near.count() > 60
    assert sorted(map(tuple, J._once(near).collect())) == [(99, i, c, [7, 9, 11]) for i, c in sorted({(i, c) for _, i, c in rows})]


@pytest.mark.parametrize("share", [0.0, 0.5, 1.1])
def test_groups_of_one_greatest_component_are_one_family_again(spark, share):
    rows = [(key, i, 5 if i < 4 else i) for key in (1, 2) for i in range(10)] + [(3, 8, 8), (3, 9, 9)]
    members = J._families(spark.createDataFrame(rows, "key bigint, node bigint, component bigint"), share)
    found = {(r["family"], r["node"]): sorted(r["keys"]) for r in J._once(members).collect()}
    assert found == {(5, i): [1, 2] for i in range(10)} | {(9, 8): [3], (9, 9): [3]}


@pytest.mark.parametrize("n", [400, 800])
def test_parts_of_one_component_do_not_meet(spark, monkeypatch, n):
    """Rows of a family with ten others grow with it; before, each of its rows entered as many tasks as it has parts."""
    monkeypatch.setattr(J, "PART", 16)
    rows = [(7, i, 7 if i >= 10 else 100 + i, 146) for i in range(n)]
    cut = J._cut(spark.createDataFrame(rows, "family bigint, node bigint, component bigint, n bigint"), "family").collect()
    assert len(cut) <= (n - 10) + 10 * (n // 16 + 2)
    tasks = {}
    for r in cut:
        tasks.setdefault((r["p"], r["q"]), {}).setdefault(r["part"], []).append(r["node"])
    met = {frozenset((a, b)) for (p, q), parts in tasks.items() for a in parts.get(p, []) for b in parts.get(q, []) if a != b}
    assert all(len(x) <= 64 for parts in tasks.values() for x in parts.values())
    assert met >= {frozenset((a, b)) for a in range(10) for b in range(n) if a != b}
    assert not any(min(x) >= 10 for x in met)


def test_a_family_of_one_component_meets_nowhere(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 4)
    rows = [(7, i, 7, 146) for i in range(20)] + [(8, i, i, 146) for i in range(3)]
    cut = J._cut(spark.createDataFrame(rows, "family bigint, node bigint, component bigint, n bigint"), "family").collect()
    assert sorted((r["family"], r["p"], r["q"], r["node"]) for r in cut) == [(8, 0, 0, i) for i in range(3)]


@pytest.mark.parametrize("part", [1, 7, 64])
def test_rows_that_have_a_near_one(monkeypatch, part):
    monkeypatch.setattr(J, "PART", part)
    rng = np.random.default_rng(3)
    layouts = J.Layouts(85, 1000)
    base = rng.integers(0, 256, (8, 128), np.uint8)
    sketch = []
    for i in range(60):
        x = np.unpackbits(base[i % 8])
        x[rng.integers(0, 1024, 5 + i // 4)] ^= 1
        sketch.append(np.packbits(x).tobytes())
    rows = [np.arange(60), np.full(60, 146), np.array(sketch, object), rng.integers(0, 20, 60)]
    meetings = [(np.arange(0, 30), np.arange(20, 60)), (np.arange(50), np.arange(50))]
    i, j = J._met(rows, meetings, layouts)
    assert 0 < len(np.union1d(i, j)) < 60
    assert np.flatnonzero(J.have_near(rows, meetings, layouts)).tolist() == np.union1d(i, j).tolist()


@pytest.mark.parametrize("part,wide,share", [(8, 1, 0.5), (8, 2, 0.0), (8, 1, 1.1)])
def test_links_of_families_cut_into_many_parts(spark, monkeypatch, part, wide, share):
    monkeypatch.setattr(J, "PART", part)
    monkeypatch.setattr(J, "WIDE", wide)
    monkeypatch.setattr(J, "FAMILY", share)
    texts = family(70) + [edited(prose(89, 146), s, (30, 60, 200)[s % 3]) for s in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    roots = brute_components([shingle_set(t, 5) for t in texts], 80)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert {r["doc_id"]: r["component_id"] for r in J.similar_texts(docs, words=5, percent=80).collect()} == {i: least[r] for i, r in enumerate(roots)}


def test_forest_of_linked_rows():
    sets = [{1, 2, 3, 4}, {1, 2, 3, 5}, {1, 2, 3, 4, 5}, {7, 8}, {7, 8}, {9}]
    hashes, size = np.concatenate([sorted(s) for s in sets]).astype(np.uint64), np.array([len(s) for s in sets])
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(6) for b in range(a + 1, 6)]))
    joined = lambda percent, component: J.linked_forest(i, j, hashes, size, np.array(component), percent)
    assert joined(80, range(6)) == [(0, 2), (1, 2), (3, 4)]
    assert joined(81, range(6)) == [(3, 4)] and joined(80, [5, 5, 5, 6, 6, 7]) == []
    assert joined(80, [5, 5, 6, 6, 7, 8]) == [(0, 2), (3, 4)]
    assert J.linked_forest(i[:0], j[:0], hashes, size, np.arange(6), 80) == []


def test_meetings_hold_all_pairs_with_a_key_in_common():
    keys, left, right = [[1], [1, 2], [2], [3], [4]], np.array([0, 1]), np.array([2, 3, 4])
    assert [(x.tolist(), y.tolist()) for x, y in J._meetings(keys, left, right)] == [([1], [2])]
    same = [[1, 2], [1, 2], [1, 2]]
    assert [len(x) for x in J._meetings(same, np.arange(3), np.arange(3))[0]] == [3, 3] and len(J._meetings(same, np.arange(3), np.arange(3))) == 1
    assert J._meetings([[1], [2]], np.array([0]), np.array([1])) == []


def test_similar_texts_on_odd_rows(spark):
    found = J.similar_texts(odd_docs(spark)).collect()
    assert len(found) == len(odd_rows())
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert all(by_id[i] == (0, i) for i in range(4)) and by_id[4] == (1, 4)
    assert by_id[7][1] == by_id[8][1] == by_id[9][1] == by_id[10][1] == 7 and by_id[11][1] == 11
    assert J.similar_texts(no_docs(spark)).count() == 0


def test_layouts_leave_a_common_block():
    layouts = J.Layouts(85, 10_000)
    for band, low in enumerate(layouts.low[:-2]):
        top = layouts.low[band + 1] - 1
        assert layouts.blocks[band] > layouts.differ(top, top) + layouts.spare[band] >= layouts.differ(low, top)
        if layouts.differ(top, top) == 0:
            assert layouts.blocks[band] == 1


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    layouts = J.Layouts(85, 10_000)
    for n in (3, 50, 700):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[n // 5:], rng.integers(0, 1 << 62, n // 6).astype(np.uint64)])
        x, y = (J._sketches(layouts, np.zeros(len(s), np.int64), s, np.array([len(s)]))[0] for s in (a, b))
        both = J._fold([x, y], min(len(x), len(y)))
        assert np.bitwise_count(both[0] ^ both[1]).sum() <= n // 5 + n // 6


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in G.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}
    assert G.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- fingerprints -----------------------------------------------------------------------


def brute_edits(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows if r[0] is not None), key=lambda r: -r[0])
    out = {}
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        new = text[:len(text) - cut] + following[:cut]
        out[key] = (len(text), hashlib.sha256(new.encode()).hexdigest(), new, following)
    return out


@pytest.mark.parametrize("ranges", [1024, 4])
def test_edits_take_the_next_document(spark, monkeypatch, ranges):
    monkeypatch.setattr(P, "RANGE_ROWS", ranges)
    rows = list(enumerate(near_docs()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in P.edited_fingerprints(spread(docs)).collect()}
    expected = brute_edits(rows)
    assert set(found) == set(expected)
    for key, (n, digest, new, following) in expected.items():
        r = found[key]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        own, other, after = P.Sketches(pa.array([dict(rows)[key], new, following])).text()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other)
        assert abs(r["near_next"] - max(P.containment(own, after), P.containment(after, own))) < 1e-9


@pytest.mark.parametrize("hot", [None, -(1 << 63), 40, (1 << 63) - 1])
def test_one_key_or_row_that_fills_many_ranges(spark, monkeypatch, hot):
    """A third of all rows share a key, another third are equal; results are those of the plain order."""
    monkeypatch.setattr(P, "RANGE_ROWS", 16)
    rows = [(i - 60, f"text {i} " + prose(i, 5)) for i in range(200)]
    rows += [(hot, f"of one key {i} " + prose(i, 4)) for i in range(200)] + [(hot, "the same row " + prose(1, 9))] * 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [tuple(r) for r in docs.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()]
    expected = Counter()
    for i, (key, text) in enumerate(order):
        cut = len(text) // 3
        new = text[:len(text) - cut] + order[(i + 1) % len(order)][1][:cut]
        expected[key, len(text), hashlib.sha256(new.encode()).hexdigest()] += 1
    found = P.edited_fingerprints(spread(docs)).select("doc_id", "n_chars", "edited_sha256").collect()
    assert Counter(tuple(r) for r in found) == expected
    sizes = P._placed(spread(docs).toDF("k", "t")).groupBy("range").agg(F.count("*").alias("n"), F.countDistinct("after").alias("a"))
    assert sizes.agg(F.max("n")).first()[0] < 130


def test_odd_rows_have_fingerprints(spark):
    found = P.edited_fingerprints(odd_docs(spark)).collect()
    assert len(found) == len(odd_rows())
    prints = {}
    for r in found:
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert prints[7] == prints[8] == prints[9] and prints[0] == prints[1] == prints[2]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert P.edited_fingerprints(no_docs(spark)).count() == 0
    only = odd_docs(spark).where("doc_id is null")
    assert P.edited_fingerprints(only).count() == 2


def test_containment_and_merging_of_unequal_texts():
    short, long_ = prose(5, 300), prose(5, 300) + " " + prose(6, 6000)
    a, b, c = P.Sketches(pa.array([short, long_, prose(8, 400)])).text()
    assert P.containment(a, b) > 0.9 and P.containment(b, a) < 0.15 and P.containment(a, c) < 0.05
    assert P.containment(a, P.merge(a, c)) == 1.0 and P.containment(c, P.merge(a, c)) == 1.0


# ---- vectors ----------------------------------------------------------------------------


def clustered(n_groups=40, dim=24):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(n_groups):
        centre = rng.normal(size=dim)
        for _ in range(1 + g % 9):
            rows.append((centre + rng.normal(size=dim) * 0.12 * np.linalg.norm(centre) / dim ** 0.5).tolist())
    rows += [rows[5], rows[5], [2 * x for x in rows[5]]]
    return [(i, [float(np.float32(x)) for x in v], i % 2 if i % 17 else None) for i, v in enumerate(rows)]


def brute_vectors(rows, threshold=0.93):
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold:
                links[a[0]] += 1
                links[b[0]] += 1
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return {r[0]: (links[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows}


@pytest.mark.parametrize("part", [2048, 3])
def test_near_vectors_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(V, "PART", part)
    inf, nan = float("inf"), float("nan")
    rows = clustered()
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [1.0, None] * 12, 1), (1004, [inf] + [1.0] * 23, 1), (1005, [nan] * 24, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.near_vectors(spread(vectors)).collect()}
    expected = brute_vectors(rows)
    total = sum(n for n, _, _ in expected.values())
    assert set(found) == set(expected) and all(found[i][0] <= expected[i][0] for i in expected)
    assert sum(n for n, _, _ in found.values()) >= 0.98 * total
    assert sum(found[i] == expected[i] for i in expected) >= 0.95 * len(expected)
    assert found[1000] == (0, 1000, True) and found[1006] == found[1007][:1] + (1006, True)
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int, node int")
    assert V.near_vectors(none).count() == 0


def test_recall_on_the_given_vectors(spark, small):
    """Measured recall of links; the bound asked for is 0.9."""
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None, r["label"]) for r in table.collect()]
    expected = brute_vectors(rows)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.near_vectors(table).collect()}
    assert found == expected


def test_nearest_pivots_with_ties():
    rng = np.random.default_rng(5)
    pivots = V._unit(rng.normal(size=(300, 12)))
    pivots[7] = pivots[3]
    vectors = np.concatenate([V._unit(rng.normal(size=(200, 12))), pivots[:20]])
    plain = [sorted(range(300), key=lambda p: (-(vectors @ pivots.T)[i, p], p))[:8] for i in range(0, 220, 11)]
    assert V.nearest_pivots(vectors, pivots)[::11].tolist() == plain
    assert V.nearest_pivots(vectors[:3], pivots[:2]).shape == (3, 2)


def test_pivots_grow_with_the_vectors():
    assert V.pivot_count(0, 64) == V.pivot_count(1000, 64) == V.PIVOTS
    assert [V.pivot_count(n, 64) for n in (10_000, 40_000, 10 ** 6, 10 ** 10)] == [400, 800, 4000, 8192]
    assert V.pivot_count(10 ** 10, 1024) * 1024 <= V.PIVOT_NUMBERS and V.pivot_count(10 ** 10, 10 ** 6) == V.PIVOTS


def test_recall_and_candidates_as_vectors_grow(spark):
    """Recall by pivots that grow, and pairs a vector meets in lists: they grow with the root of the vectors, not with their number."""
    rng = np.random.default_rng(9)
    met = []
    for n in (2_000, 18_000):
        centres = rng.normal(size=(n // 4, 32))
        x = V._unit(np.repeat(centres, 4, 0) + rng.normal(size=(n, 32)) * 0.15)
        near = V.nearest_pivots(x, V.choose_pivots(x[rng.permutation(n)], V.pivot_count(n, 32)))
        met.append((np.bincount(near.ravel()).astype(float) ** 2).sum() / n)
        links = shared = 0
        for i in range(0, n, 4):  # near vectors come in fours
            for a in range(i, i + 4):
                for b in range(i, a):
                    if x[a] @ x[b] >= 0.93:
                        links += 1
                        shared += len(set(near[a]) & set(near[b])) >= V.SHARED
        assert links > n / 4 and shared >= 0.97 * links
    assert met[1] < 5 * met[0]
