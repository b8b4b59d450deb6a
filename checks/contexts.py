"""Contexts, their statistics and the constraint test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit.functions import draws
from aislekit.functions.constraints import constraint
from aislekit.functions.products import item_phrase
from aislekit.operators import contexts as C
from checks import base as B
from checks.base import check, using


@check("drawn_contexts", using("drawn", "SELECT ctx_id, category, sub_category, n_products FROM drawn"))
def drawn_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.draw_contexts(B.requests(spark, sf_dir), B.library(spark, sf_dir), B.SEED)


@check("context_products", using("ctxp", """
SELECT ctx_id, pos, product_id, category, title, round(price, 6) AS price, brand FROM ctxp"""))
def context_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.context_rows(B.contexts(spark, sf_dir)).select(
        "ctx_id", F.col("pos").cast("bigint").alias("pos"), "product_id", "category", "title",
        F.round("price", 6).alias("price"), "brand",
    )


# One row per use of a feature, with its place in the context.
_USES = ("uses", """SELECT ctx_id, pos, product_id, unnest(features) AS feature,
  generate_subscripts(features, 1) AS i FROM ctxp""")
_FREQ = ("freq", "SELECT ctx_id, feature, count(*) AS n, min(pos * 1000 + i) AS place FROM uses GROUP BY ctx_id, feature")
_TARGET = ("target", f"""SELECT c.* FROM ctxp c JOIN (SELECT ctx_id, count(*) AS n FROM ctxp GROUP BY ctx_id) s USING (ctx_id)
  WHERE c.pos = {B.index(B.digest('target', 'c.ctx_id'), 's.n')}""")
_PAIRS = ("pairs", """SELECT a.ctx_id, a.feature AS f1, b.feature AS f2, count(DISTINCT a.pos) AS n FROM uses a JOIN uses b
  ON a.ctx_id = b.ctx_id AND a.pos = b.pos AND a.feature < b.feature GROUP BY ALL""")
_RANGES = ("ranges", """SELECT ctx_id, min(price) AS low, max(price) AS high, min(avg_rating) AS rating_low,
  max(avg_rating) AS rating_high FROM ctxp GROUP BY ctx_id""")


@check("feature_frequency", using("ctxp", """SELECT ctx_id, feature, n,
  row_number() OVER (PARTITION BY ctx_id ORDER BY place) - 1 AS first_seen FROM freq""", _USES, _FREQ))
def feature_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = C.feature_freq(B.contexts(spark, sf_dir))
    return freq.select("ctx_id", "feature", F.col("n").cast("bigint").alias("n"), F.col("first_seen").cast("bigint").alias("first_seen"))


@check("rare_and_common_features", using("ctxp", """
SELECT t.ctx_id, t.product_id,
  coalesce((SELECT string_agg(u.feature, '|' ORDER BY u.i) FROM uses u JOIN freq f ON f.ctx_id = u.ctx_id AND f.feature = u.feature
    WHERE u.ctx_id = t.ctx_id AND u.pos = t.pos AND f.n = 1), '') AS rare,
  coalesce((SELECT string_agg(u.feature, '|' ORDER BY u.i) FROM uses u JOIN freq f ON f.ctx_id = u.ctx_id AND f.feature = u.feature
    WHERE u.ctx_id = t.ctx_id AND u.pos = t.pos AND f.n > 1), '') AS common
FROM target t""", _USES, _FREQ, _TARGET))
def rare_and_common_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = C.rare_common(C.draw_target(B.contexts(spark, sf_dir), B.SEED))
    return ctx.select(
        "ctx_id", "target.product_id", F.array_join("rare", "|").alias("rare"), F.array_join("common", "|").alias("common")
    )


@check("feature_cooccurrence", using("ctxp", "SELECT ctx_id, f1, f2, n FROM pairs", _USES, _PAIRS))
def feature_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cooccurrence(B.contexts(spark, sf_dir))


@check("absent_feature_pairs", using("ctxp", """
SELECT a.ctx_id, a.feature AS f1, b.feature AS f2 FROM freq a JOIN freq b ON a.ctx_id = b.ctx_id AND a.feature < b.feature
ANTI JOIN pairs p ON p.ctx_id = a.ctx_id AND p.f1 = a.feature AND p.f2 = b.feature""", _USES, _FREQ, _PAIRS))
def absent_feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.absent_pairs(B.contexts(spark, sf_dir))


@check("context_diversity", using("ctxp", """
SELECT ctx_id, coalesce(array_to_string(list_sort(list(DISTINCT brand) FILTER (length(brand) > 0)), '|'), '') AS brands,
  round(coalesce(min(price), 0.0), 6) AS min_price, round(coalesce(max(price), 0.0), 6) AS max_price,
  round(coalesce(min(avg_rating), 0.0), 6) AS min_rating, round(coalesce(max(avg_rating), 0.0), 6) AS max_rating
FROM ctxp GROUP BY ctx_id"""))
def context_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = C.diversity(B.contexts(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("min_price", "max_price", "min_rating", "max_rating")]
    return wide.select("ctx_id", F.array_join("brands", "|").alias("brands"), *rounded)


@check("top_feature", using("ctxp", """
SELECT ctx_id, coalesce((SELECT feature FROM freq f WHERE f.ctx_id = c.ctx_id AND f.n >= 2
  ORDER BY f.n DESC, f.place LIMIT 1), '') AS feature FROM (SELECT DISTINCT ctx_id FROM ctxp) c""", _USES, _FREQ))
def top_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_feature(B.contexts(spark, sf_dir))


@check("repeat_brands", using("ctxp", """
SELECT ctx_id, brand FROM ctxp WHERE length(brand) > 0 GROUP BY ctx_id, brand HAVING count(*) >= 2"""))
def repeat_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeat_brands(B.contexts(spark, sf_dir))


@check("range_points", using("ctxp", """
SELECT ctx_id, round(coalesce(low + (high - low) * 0.7::DOUBLE, 200.0), 6) AS target_price,
  round(rating_low + (rating_high - rating_low) * 0.3::DOUBLE, 6) AS rating_floor FROM ranges""", _RANGES))
def range_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = C.range_points(B.contexts(spark, sf_dir))
    return points.select(
        "ctx_id", F.round("target_price", 6).alias("target_price"), F.round("rating_floor", 6).alias("rating_floor")
    )


# A constraint on every context: a price point, the top feature, a rating point, and every third time a brand.
_CONS = ("cons", """SELECT r.ctx_id, low + (high - low) * 0.7::DOUBLE AS max_price,
  CASE WHEN r.ctx_id % 3 = 0 THEN (SELECT brand FROM ctxp c WHERE c.ctx_id = r.ctx_id AND c.pos = 0) END AS brand,
  (SELECT feature FROM freq f WHERE f.ctx_id = r.ctx_id AND f.n >= 2 ORDER BY f.n DESC, f.place LIMIT 1) AS feature,
  rating_low + (rating_high - rating_low) * 0.3::DOUBLE AS min_rating FROM ranges r""")
_MET = ("met", """SELECT p.* FROM ctxp p JOIN cons c USING (ctx_id)
  WHERE (c.max_price IS NULL OR p.price IS NULL OR p.price <= c.max_price)
    AND (c.brand IS NULL OR c.brand = '' OR coalesce(p.brand, '') = c.brand)
    AND (c.feature IS NULL OR list_contains(p.features, c.feature))
    AND (c.min_rating IS NULL OR p.avg_rating IS NULL OR p.avg_rating >= c.min_rating)""")


def _constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = F.col("products")
    feature = C.top(C.frequency(products), 2)
    return B.contexts(spark, sf_dir).withColumn("constraint", constraint(
        C.point_between(C.prices(products), 0.7),
        F.when(F.col("ctx_id") % 3 == 0, F.get(products, F.lit(0))["brand"]),
        F.when(feature != "", F.array(feature)).otherwise(F.array().cast("array<string>")),
        C.point_between(C.ratings(products), 0.3),
    ))


@check("satisfying_ids", using("ctxp", """
SELECT c.ctx_id, coalesce((SELECT string_agg(product_id, '|' ORDER BY pos) FROM met m WHERE m.ctx_id = c.ctx_id), '') AS ids
FROM cons c""", _USES, _FREQ, _RANGES, _CONS, _MET))
def satisfying_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = C.satisfying_ids(_constrained(spark, sf_dir))
    return met.select("ctx_id", F.array_join("satisfying_ids", "|").alias("ids"))


@check("competitor_bounds", using("ctxp", """
SELECT t.ctx_id, round(min(m.price), 6) AS min_price, round(max(m.avg_rating), 6) AS max_rating
FROM target t LEFT JOIN met m ON m.ctx_id = t.ctx_id AND m.product_id <> t.product_id GROUP BY t.ctx_id""",
    _USES, _FREQ, _RANGES, _CONS, _MET, _TARGET))
def competitor_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = C.competitor_bounds(C.draw_target(_constrained(spark, sf_dir), B.SEED))
    return bounds.select("ctx_id", F.round("min_price", 6).alias("min_price"), F.round("max_rating", 6).alias("max_rating"))


@check("closest_products", using("ctxp", """
SELECT ctx_id, string_agg(product_id, '|' ORDER BY rank) AS closest FROM (
  SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY shared DESC, same DESC, away, pos) AS rank FROM (SELECT * FROM (
    SELECT p.ctx_id, p.pos, p.product_id, CASE WHEN p.category = t.category THEN 1 ELSE 0 END AS same,
      (SELECT count(DISTINCT x) FROM (SELECT unnest(p.features) AS x) WHERE list_contains(t.features, x)) AS shared,
      abs(coalesce(p.price, 0.0) - coalesce(t.price, 0.0)) AS away
    FROM ctxp p JOIN target t USING (ctx_id))
  QUALIFY row_number() OVER (PARTITION BY ctx_id, product_id ORDER BY shared DESC, same DESC, away, pos) = 1))
WHERE rank <= 2 GROUP BY ctx_id""", _TARGET))
def closest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = C.draw_target(B.contexts(spark, sf_dir), B.SEED).withColumns({
        "desired": F.col("target.features"), "category": F.col("target.category"),
        "wished_price": F.coalesce(F.col("target.price"), F.lit(0.0)),
    })
    near = C.closest_products(ctx, "desired", "category", "wished_price")
    return near.select("ctx_id", F.array_join(F.transform("closest", lambda p: p["product_id"]), "|").alias("closest"))


def phrase_sql(salt: str, fallback: str) -> str:
    """(ctx_id, phrase) from ctxp."""
    return f"""SELECT ctx_id, CASE WHEN title IS NULL THEN '{fallback}' ELSE lower(CASE
        WHEN len(words) > 1 AND list_contains(brands, words[1]) THEN array_to_string(words[2:], ' ') ELSE core END) END AS phrase
      FROM (SELECT *, string_split(core, ' ') AS words FROM (
        SELECT *, trim(split_part(title, ' - ', 1)) AS core FROM (
          SELECT ctx_id, list(brand) FILTER (length(brand) > 0) AS brands,
            (list(title ORDER BY pos) FILTER (length(title) > 0))[1 + {B.index(B.digest(salt, 'ctx_id'), 'count(*) FILTER (length(title) > 0)')}] AS title
          FROM ctxp GROUP BY ctx_id)))"""


@check("item_phrases", using("ctxp", phrase_sql("item", "product")))
def item_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = draws.digest(B.SEED, "item", F.col("ctx_id"))
    return B.contexts(spark, sf_dir).select("ctx_id", item_phrase(F.col("products"), drawn, "product").alias("phrase"))
