import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aislekit.llm import kd_shards as K, mixing as M
from cases import no_docs, odd_docs, odd_rows, prose, spread


def docs_of(spark, n=600):
    rows = [(i, prose(i % 500, 5 + (i * 37) % 200), ("en", "de", None)[i % 3], f"src{i % 7 if i % 3 else 0}", i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")


def test_shards_are_near_equal_and_gapless(spark):
    rows = K.shard_tree(docs_of(spark), shards=7).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 600 and set(sizes) == set(range(7)) and {r["law"] for r in rows} == {"bytes"}
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_texts_share_a_shard(spark):
    text = {r["doc_id"]: r["text"] for r in docs_of(spark).collect()}
    places = defaultdict(set)
    for r in K.shard_tree(docs_of(spark), shards=3).collect():
        places[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(p) > 1 for p in places.values()) <= 2


def test_a_huge_group_is_spread(spark):
    docs = docs_of(spark, 300).union(spark.range(1000, 1600).select(
        "id", F.lit("the very same text " * 20), F.lit("en"), F.lit("src0"), F.lit(1)))
    sizes = Counter()
    for r in K.shard_tree(docs, shards=8).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.2 * min(sizes.values())


@pytest.mark.parametrize("doc_id", [7, None])
def test_a_huge_group_of_equal_rows_is_spread(spark, doc_id):
    """The rows are equal in all columns, so that no id tells them apart."""
    docs = docs_of(spark, 300).union(spark.range(0, 600, 1, 3).select(
        F.lit(doc_id).cast("bigint"), F.lit("the very same text " * 20), F.lit("en"), F.lit("src0"), F.lit(1)))

    def places(df):
        return sorted((r["doc_id"] or -1, r["size"], r["shard"], r["slot"]) for r in K.shard_tree(df, shards=8).collect())

    found, sizes, slots = places(docs), Counter(), defaultdict(list)
    for _, size, shard, slot in found:
        sizes[shard] += size
        slots[shard].append(slot)
    assert len(found) == 900 and max(sizes.values()) < 1.2 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert places(spread(docs, 5)) == found


def test_every_shard_against_a_plain_tree(spark):
    """The tree cut step by step over the points of the operator, on 200 rows."""
    docs, shards = docs_of(spark, 200), 7
    names = ["source", "lang", "n_chars"]
    points = [r.asDict() for r in K._points(docs, "doc_id", "text", names, shards, K.SEED).collect()]
    wide = [max(p[f"d{i}"] for p in points) - min(p[f"d{i}"] for p in points) or 1e-300 for i in range(3)]

    def cut(some, m):
        if m == 1:
            return [some]
        edges = [(min(p[f"d{i}"] for p in some), max(p[f"d{i}"] for p in some)) for i in range(3)] if some else [(0, 0)] * 3
        dim = max(range(3), key=lambda i: (edges[i][1] - edges[i][0]) / wide[i])
        low, high = edges[dim]

        def order(p):
            cell = int((p[f"d{dim}"] - low) / (high - low) * float((1 << K.COORDINATE) - 1)) if high > low else 0
            return cell * (1 << K.TIE) + p["tie"]

        weight = Counter()
        for p in some:
            weight[order(p)] += p["size"]
        goal, upto, edge = sum(weight.values()) * (m // 2) / m, 0, None
        for key in sorted(weight):
            before, upto = upto, upto + weight[key]
            if upto >= goal:
                edge = key + (upto - goal < goal - before)
                break
        return cut([p for p in some if order(p) < edge], m // 2) + cut([p for p in some if order(p) >= edge], m - m // 2)

    expected = {p["key"]: shard for shard, part in enumerate(cut(points, shards)) for p in part}
    assert {r["doc_id"]: r["shard"] for r in K.shard_tree(docs, shards=shards).collect()} == expected


def test_odd_rows_are_sharded(spark):
    rows = K.shard_tree(odd_docs(spark), shards=4).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert K.shard_tree(no_docs(spark), shards=4).count() == 0


def test_shards_do_not_depend_on_partitions(spark):
    def key(df):
        return sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())

    assert key(K.shard_tree(docs_of(spark), shards=5)) == key(K.shard_tree(spread(docs_of(spark), 3), shards=5))


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Step by step: what is above a cap is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = goal - sum(capped.values())
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if now[s] > most * sizes[s]}
        if not over:
            return {**capped, **now}
        capped |= over


@pytest.mark.parametrize("case", ["plain", "odd"])
def test_mix_keeps_its_contract(spark, case):
    docs = docs_of(spark) if case == "plain" else odd_docs(spark)
    rows = M.mix_sources(docs).collect()
    source = defaultdict(list)
    for r in docs.collect():
        source[r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))].append(r["source"])
    sizes = Counter()
    for (_, size), names in source.items():
        for s in names:
            sizes[s] += size
    expected, taken = targets(sizes), Counter()
    assert len(rows) == docs.count()
    for r in rows:
        names = source[r["doc_id"], r["size"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert any(sizes[s] == r["source_size"] and abs(expected[s] - r["target"]) < 1e-6 for s in names)
        taken[names[0]] += r["taken"]
    for s, target in expected.items():
        assert abs(taken[s] - target) <= min(M.BLOCK, max(0.5, 0.1 * target))


def test_small_sources_come_near_their_targets(spark):
    sizes = {"a": 1, "b": 3, "c": 15, "d": 33, "e": 70, "f": 1000, "g": 64, "h": 128, "i": 2}
    rows = [(i, " ".join(f"{s}{j}" for j in range(i, n, 3)), s) for s, n in sizes.items() for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in range(4):
        found = M.Mixture(docs, seed=seed)
        taken = Counter()
        counted = found.documents.join(found.taken(), "doc", "left").collect()
        for r in counted:
            taken[r["source_no"]] += r["taken"] or 0
            assert (r["taken"] or 0) <= 2 * r["size"]
        for (no, size), target in {(r["source_no"], r["source_size"]): r["target"] for r in counted}.items():
            assert size > 0 and abs(taken[no] - target) <= min(M.BLOCK, max(0.5, 0.1 * target))
        mixed = Counter()
        for r in M.mixed_texts(docs, found, seed=seed).collect():
            mixed[r["source"]] += len(r["text"].split())
        assert mixed == {s: n for s, n in zip(sorted(sizes), (taken[i] for i in range(len(sizes)))) if n}


def test_a_repeated_row_under_clashing_names_is_mixed(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 5, 6)] * 30 + [(2, "d e", "t", 7, 8)], "doc_id bigint, text string, source string, __h int, __text int")
    rows = M.mixed_texts(docs, M.Mixture(docs)).collect()
    assert {(r["__h"], r["__text"]) for r in rows} <= {(5, 6), (7, 8)} and sum(len(r["text"].split()) for r in rows) in range(134, 144)


def test_mix_reruns_agree_and_nothing_mixes_to_nothing(spark):
    def key(df):
        return sorted((r["doc_id"], r["taken"]) for r in M.mix_sources(df).collect())

    assert key(docs_of(spark)) == key(spread(docs_of(spark), 3))
    assert M.mix_sources(no_docs(spark)).count() == 0


def test_permutations_are_bijections_with_inverse(spark):
    for n in (1, 2, 7, 100, 1023):
        rows = spark.range(n).withColumn("n", F.lit(n).cast("bigint")).withColumn("keys", M._keys(F.col("n"), F.lit(3)))
        rows = rows.withColumn("p", M.permuted(F.col("id"), F.col("n"), F.col("keys")))
        rows = rows.withColumn("back", M.permuted(F.col("p"), F.col("n"), F.reverse("keys"))).collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_slots_fill_the_shards(spark):
    mixture = M.Mixture(docs_of(spark), shard=64)
    rows = mixture.slots.collect()
    assert sorted(r["shard"] * 64 + r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["epoch"] in (0, 1) for r in rows)


def test_mixed_texts_hold_the_words_taken(spark):
    docs = docs_of(spark, 200)
    mixture = M.Mixture(docs)
    words = Counter()
    original = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in M.mixed_texts(docs, mixture).collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert set(r["text"].split()) <= set(original[r["doc_id"]])
    taken = {r["doc_id"]: r["taken"] for r in M.mix_sources(docs).collect()}
    assert {d: n for d, n in taken.items() if n} == dict(words)
    assert M.mixed_texts(odd_docs(spark), M.Mixture(odd_docs(spark))).columns == odd_docs(spark).columns
