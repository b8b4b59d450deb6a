"""Small tables with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars int, k int, t string, h bigint, node string, "
          "`row` int, size string, n int, bucket int, piece_ids string, mark string")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def edited(text: str, seed: int, every: int) -> str:
    words = text.split(" ")
    for i in range(seed % every, len(words), every):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    texts = [
        None, "", " ", "\n\t ", "one", "One  two", " lead and trail ", base, base, base.upper(), edited(base, 3, 60), edited(base, 4, 10),
        "x" * 30_000, "word " * 6000, "日本語 のテキスト ▁ é́ 𝔘\x00\x01", "mail a.b@c.example.org or +1 (605) 555-9305, 10.0.0.256 1.2.3.4",
        "4539 1488 0343 6467 and 4539-1488-0343-6468", "a@b@c.d.e @ . ..", "<s> </s> <unk> <0x0A>",
    ]
    rows = []
    for i, text in enumerate(texts):
        lang, source = (None, "en", "de")[i % 3], ("s1", None, "s2", "s1")[i % 4]
        n = None if i % 5 == 0 else len(text or "")
        rows.append((i, text, lang, source, n, i, "t", None, "node", 1, "big", 2, 3, "p", "m"))
    rows.append(rows[7])  # a repeated row
    rows.append((None, "no id at all here", None, None, None, *rows[0][5:]))
    rows.append((None, None, None, None, None, *[None] * 10))
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def spread(df, n=5):
    """The same rows in other partitions."""
    return df.repartition(n)
