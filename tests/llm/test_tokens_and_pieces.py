import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from aislekit.llm import piece_sampling as S, token_counts as C
from cases import no_docs, odd_docs, odd_rows, spread

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def random_texts(n):
    rng = random.Random(5)
    alphabet = "abcdeABC  ▁\n\t.,'01é日𝔘\x00\r"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_are_the_library_s():
    texts = random_texts(800) + [r[1] or "" for r in odd_rows()]
    expected = [len(ids) for ids in C.processor(MODEL).encode(texts, num_threads=1)]
    assert C.Counter(MODEL).counts(texts) == expected
    tiny = C.Counter(MODEL, memo=10)  # a memo that starts anew all the time
    assert [tiny.counts([t])[0] for t in texts] == expected


def test_proven_strings_are_single_tokens():
    sp, whole = C.processor(MODEL), C.proven(MODEL)
    assert len(whole) > 10_000 and all(len(sp.encode(t)) == 1 for t in list(whole)[::97])
    assert not C.splits_at_blanks(["a▁b"]) and C.splits_at_blanks(["▁▁a", "b"])


def test_count_tokens_on_odd_rows(spark):
    rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in C.count_tokens(odd_docs(spark), MODEL).collect()}
    sp = C.processor(MODEL)
    expected = {(r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in odd_rows()}
    assert rows == expected
    assert C.count_tokens(no_docs(spark), MODEL).count() == 0


def test_pieces_round_trip_and_do_not_depend_on_partitions(spark):
    docs = odd_docs(spark)
    found = S.encode(docs, MODEL)
    assert set(docs.columns) | {"lossless"} == set(found.columns)
    rows = found.collect()
    assert all(r["lossless"] for r in rows) and len(rows) == len(odd_rows())
    key = lambda rows: Counter((r["doc_id"], tuple(r["piece_ids"])) for r in rows)
    assert key(rows) == key(S.encode(spread(docs), MODEL).collect())
    texts = Counter((r["doc_id"], r["decoded"]) for r in S.decode(found, MODEL).collect())
    assert texts == Counter((r[0], r[1] or "") for r in odd_rows())
    assert S.encode(no_docs(spark), MODEL).count() == 0


def test_pieces_of_random_texts_decode_in_the_library_too():
    texts = [t.replace("▁", "") for t in random_texts(400)]
    lattice = S.lattice(MODEL)
    ids, ends = lattice.encode(texts, np.arange(len(texts), dtype=np.int64))
    sp = C.processor(MODEL)
    assert [sp.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])] == texts


@pytest.mark.parametrize("word", ["there", "a b", "bananas"])
def test_draws_follow_the_lattice(word):
    """Shares of all segmentations, against their enumeration."""
    lattice, n = S.lattice(MODEL), 20_000
    text = "▁" + word.replace(" ", "▁")
    weights = {}

    def walk(at, ids, weight):
        if at == len(text):
            weights[tuple(ids)] = weight
        for end in range(at + 1, len(text) + 1):
            i = lattice.ids.get(text[at:end])
            if i is not None:
                walk(end, [*ids, i], weight * lattice.weight[i])

    walk(0, [], 1.0)
    ids, ends = lattice.encode([word] * n, np.arange(n, dtype=np.int64))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends, ends[1:]))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for way, weight in weights.items():
        assert abs(seen[way] / n - weight / total) < 0.015


def test_long_segments_are_drawn_alike():
    """A segment longer than the table width takes the other path and still decodes."""
    lattice = S.lattice(MODEL)
    texts = ["abcdefgh" * 20, "é" * 90, "日" * 50, "x" * 25]
    ids, ends = lattice.encode(texts, np.arange(4, dtype=np.int64))
    data, edges = lattice.decode(ids, ends)
    assert [data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])] == texts


def peak_mb(run):
    """Megabytes that a call holds at once beyond what was held before it."""
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_large_batch_of_texts_is_encoded_in_little_memory(spark, monkeypatch):
    import pyarrow as pa

    taken = []
    monkeypatch.setattr(S, "map_arrow", lambda df, run, schema: taken.append(run) or df)
    S.encode(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), MODEL)
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, n))) for n in rng.integers(1, 9, 20_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 560)) for _ in range(1000)]  # three megabytes
    keys = pa.array(range(1000), pa.int64())
    batch = pa.RecordBatch.from_arrays([keys, pa.array(texts), pa.array(texts), keys], names=["c0", "c1", "t", "k"])
    list(taken[0](iter([batch.slice(0, 1)])))  # the vocabulary's tables stay
    out = []
    assert peak_mb(lambda: out.extend(taken[0](iter([batch])))) < 130
    assert out[0].num_rows == 1000 and all(out[0].column(3).to_pylist())


def test_texts_without_personal_data_take_little_memory():
    import pyarrow as pa

    from aislekit.llm import pii

    column = pa.array(["no such thing here, " * 150] * 1000 + ["write to a.b@c.de today", None, ""])
    found = []
    assert peak_mb(lambda: found.extend(pii._found(column, None))) < 40
    assert [len(own) for own, _ in found] == [0] * 1000 + [1, 0, 0]


def test_word_hashes_take_little_memory_and_do_not_depend_on_places():
    import pyarrow as pa

    from aislekit.llm import base

    rng = np.random.default_rng(6)
    texts = [" ".join("".join(map(chr, rng.choice([65, 66, 97, 98, 122, 233, 0x4E2D], n))) for n in rng.integers(1, 40, 300)) for _ in range(60)] + ["", "x" * 256, "a"]
    words = base.Words(pa.array(texts))

    def one(word: bytes) -> int:
        total = sum(int(base.LOWER_VALUES[c]) * pow(0x5851F42D4C957F2D, i, 1 << 64) for i, c in enumerate(word)) + len(word) * 0x9E3779B97F4A7C15
        return int(base.mix(np.array([total & (1 << 64) - 1], np.uint64))[0])

    raw = words.data.tobytes()
    assert len(raw) > 4 * base.CHUNK_BYTES // 16 and words.hashes().tolist() == [one(raw[a:b]) for a, b in zip(words.start, words.end)]
    # one byte before the others moves every word, and changes none
    moved = base.Words(pa.array(["y", *texts])).hashes()
    assert moved[1:].tolist() == words.hashes().tolist()
    plain = base.Words(pa.array(["some words of a plain text " * 1000] * 40))
    assert peak_mb(plain.hashes) < 40 * len(plain.data) / 1e6
