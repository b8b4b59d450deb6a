"""One query per operator over its whole table, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit.llm import (
    fingerprints, kd_shards, lm, mixing, parity_join, pii, piece_sampling, pivots, ranked_search, repeated_phrases,
    run_detection, token_counts, toxicity,
)
from aislekit.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.train(docs))


@query("op2_kd_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_tree(table(spark, sf_dir, "documents"))


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_MODEL)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


@query("op6_similar_texts", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_texts(table(spark, sf_dir, "documents"))


@query("op7_mixed_sources")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op8_lm_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id"""


@query("op9_near_vectors", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_sampled_pieces")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, lossless for every document."""
    return piece_sampling.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, keep=["doc_id"])


OP11_SQL = r"""
WITH t AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, CASE WHEN doc_id IS NULL THEN 0 ELSE
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) END AS h FROM documents, t),
e AS (SELECT row, doc_id, len(ws) AS n, h, ws, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM d),
k AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE ws END AS ws FROM e),
w AS (SELECT row, n, unnest(ws) AS w, unnest(range(n)) AS i FROM k),
g AS (SELECT row, n, unnest(range(n - 7)) AS i, unnest(list_transform(range(1, n - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM k WHERE n >= 24),
m AS (SELECT x.row, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.row = y.row AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT row, q, min(i) AS s, max(i) + q + 8 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM m) GROUP BY row, q, island),
c AS (SELECT * FROM s WHERE e - s >= greatest(24, 3 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.row = c.row AND o.q < c.q AND o.s <= c.s AND o.e >= c.e)),
b AS (SELECT row, count(*) AS n_runs, arg_max({'s': s, 'l': e - s, 'q': q}, {'x': (e - s) / q, 's': -s, 'q': -q}) AS best, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY row),
x AS (SELECT DISTINCT row, unnest(range(s + q, e)) AS i FROM r),
y AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM k LEFT JOIN b USING (row) LEFT JOIN y USING (row)"""


@query("op11_periodic_runs", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_detection.describe_runs(table(spark, sf_dir, "documents"), tails=True)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT row, unnest(range(len(ws) - 34)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) AS s FROM d WHERE len(ws) >= 35),
r AS (SELECT row, i FROM v WHERE s IN (SELECT s FROM v GROUP BY s HAVING count(*) > 1)),
c AS (SELECT DISTINCT row, i + j AS i FROM r, (SELECT unnest(range(35)) AS j)),
w AS (SELECT row, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
k AS (SELECT row, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (row, i) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)"""


@query("op12_repeated_phrases", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_phrases.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS ws, row_number() OVER () AS row FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
o AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
f AS (SELECT term, count(*) AS df FROM o GROUP BY term),
m AS (SELECT row, doc_id, 10 + ((90 * len(ws) * n_docs) // n_terms) AS m FROM d, s WHERE len(ws) > 0),
p AS (SELECT q.item_id, o.row, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN o USING (term) JOIN m USING (row), s GROUP BY q.item_id, o.row),
r AS (SELECT p.item_id, row_number() OVER (PARTITION BY p.item_id ORDER BY p.score DESC, m.doc_id)::INTEGER AS rank, m.doc_id, p.score FROM p JOIN m USING (row) WHERE p.score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
