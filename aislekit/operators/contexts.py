"""Groups of similar products (contexts) and what is known about each of them.

A context is one row with an array of at most eight product structs, so everything about
it is a Column on that row: no join, no shuffle, no group that can grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from aislekit import schemas, vocabulary as V
from aislekit.functions.constraints import ids, satisfying
from aislekit.functions.draws import digest, distinct_positions, let, pick, unit
from aislekit.functions.products import slug
from aislekit.session import spread, written

_GROUP = ["category", "sub_category"]
_BUCKET_DIGITS = 3


# ---- drawing -----------------------------------------------------------------------


def _named(library: DataFrame) -> DataFrame:
    return library.where((F.length("category") > 0) & (F.length("sub_category") > 0))


def number_products(library: DataFrame) -> DataFrame:
    """(category, sub_category, product_id, copy, position): the products numbered 1 … n inside their
    sub-category, and rows that share an id numbered from 1 as copies. Only these columns are read.

    Numbered inside buckets of the id's digest, then shifted by the rows of the buckets
    before. The largest sub-category is thus sorted by 4,096 tasks instead of one.
    """
    ids = _named(library).select(*_GROUP, "product_id")
    bucketed = ids.withColumn("bucket", F.substring(F.md5("product_id"), 1, _BUCKET_DIGITS))
    counts = bucketed.groupBy(*_GROUP, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(W.partitionBy(*_GROUP).orderBy("bucket")) - F.col("rows")
    shifts = counts.select(*_GROUP, "bucket", before.alias("before"))
    inside = W.partitionBy(*_GROUP, "bucket").orderBy("product_id")
    return (
        bucketed.withColumns({"inside": F.row_number().over(inside), "first": F.rank().over(inside)})
        .join(shifts, [*_GROUP, "bucket"])
        .select(
            *_GROUP, "product_id", (F.col("inside") - F.col("first") + 1).alias("copy"),
            (F.col("before") + F.col("inside")).alias("position"),
        )
    )


def context_requests(spark: SparkSession, n: int) -> DataFrame:
    """n context ids."""
    return spark.range(n).select(F.col("id").alias("ctx_id"))


def draw_contexts(requests: DataFrame, library: DataFrame, seed: int) -> DataFrame:
    """A category and then a sub-category for each `ctx_id`, both uniformly.

    Gives (ctx_id, category, sub_category, n_products). The sub-categories with their sizes are one
    array in one row, looked up by number: no join, so no key that many contexts share. Requests are narrow, so one
    file, and one task, may hold millions of them: they are dealt to all tasks before anything is drawn.
    """
    subs = _named(library).groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n_products"))
    listed = subs.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("sub_category", "n_products"))).alias("subs"))
    categories = listed.agg(F.array_sort(F.collect_list(F.struct("category", "subs")))).scalar()

    def one_of(values: Column, salt: str) -> Column:
        return F.get(values, F.floor(unit(digest(seed, salt, F.col("ctx_id"))) * F.size(values)).cast("int"))

    drawn = spread(requests.select("ctx_id")).select("ctx_id", one_of(categories, "category").alias("c"))
    drawn = drawn.select("ctx_id", F.col("c.category").alias("category"), one_of(F.col("c.subs"), "sub_category").alias("s"))
    return drawn.select("ctx_id", "category", "s.sub_category", "s.n_products").where("sub_category IS NOT NULL")


def context_products(drawn: DataFrame, library: DataFrame, seed: int, k: int = V.CONTEXT_SIZE) -> DataFrame:
    """The drawn contexts with their products: k random ones, or all by id if there are fewer.

    Each context looks up k positions, so a row meets a row; a context is never joined
    with a whole sub-category. Positions are settled on the ids alone and written; titles and
    features are then read of the wanted products only, filtered in place where the wanted
    ids are few enough for Spark to send them to every task.
    """
    few = F.col("n_products") < k
    positions = F.when(few, F.sequence(F.lit(1).cast("bigint"), F.col("n_products"))).otherwise(
        distinct_positions(F.col("n_products"), k, seed, "position", F.col("ctx_id"))
    )
    wanted = drawn.withColumn("position", F.explode(positions)).withColumn(
        "place", F.when(few, F.lit("")).otherwise(digest(seed, "place", F.col("ctx_id"), F.col("position")))
    )
    # k rows a context: nothing to send to every task, however small the requests look to the planner
    picked = wanted.hint("merge").join(number_products(library), [*_GROUP, "position"]).select("ctx_id", *_GROUP, "place", "product_id", "copy")
    picked = written(picked, "picked")
    found = _named(library).join(picked.select(*_GROUP, "product_id").distinct(), [*_GROUP, "product_id"], "left_semi")
    product = F.struct(
        "product_id", slug(F.col("sub_category")).alias("category"), "title", "price", "brand",
        F.col("features").alias("features"), "avg_rating",
    ).cast(schemas.CONTEXT_PRODUCT)
    copies = W.partitionBy(*_GROUP, "product_id").orderBy(F.xxhash64("title", "price", "brand", "features", "avg_rating"))
    found = found.withColumn("copy", F.row_number().over(copies)).select(*_GROUP, "product_id", "copy", product.alias("product"))
    members = picked.join(found, [*_GROUP, "product_id", "copy"])
    # A window instead of collect_list in a groupBy: rows of a context arrive from many tasks, so
    # there is nothing to combine before the shuffle, and one sort puts them in order.
    context = W.partitionBy("ctx_id")
    in_order = context.orderBy("place", "product_id")
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        members.select("ctx_id", *_GROUP, "place", "product_id", "product")
        .withColumns({"rank": F.row_number().over(in_order), "products": F.collect_list("product").over(whole)})
        .where(F.col("rank") == 1)
        .select("ctx_id", *_GROUP, "products")
    )


def build_contexts(requests: DataFrame, library: DataFrame, seed: int, k: int = V.CONTEXT_SIZE) -> DataFrame:
    """Contexts (ctx_id, category, sub_category, products) for the requested ids."""
    return context_products(draw_contexts(requests, library, seed), library, seed, k)


def context_rows(ctx: DataFrame) -> DataFrame:
    """The products of the contexts as rows (ctx_id, pos, …), pos from 0."""
    return ctx.select("ctx_id", F.posexplode("products").alias("pos", "product")).select(
        "ctx_id", "pos", "product.*"
    )


# ---- columns on the product array ----------------------------------------------------


def features_in(products: Column) -> Column:
    """All features in order of appearance, repeats included."""
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(products, lambda p: F.coalesce(p["features"], none)))


def frequency(products: Column) -> Column:
    """(feature, n) in order of first appearance."""
    return let(features_in(products), lambda feats: F.transform(
        F.array_distinct(feats),
        lambda f: F.struct(f.alias("feature"), F.when(f.isNull(), 0).otherwise(F.size(feats) - F.size(F.array_remove(feats, f))).alias("n")),
    ))


def count_of(freq: Column, feature: Column) -> Column:
    return F.get(F.filter(freq, lambda e: e["feature"] == feature), F.lit(0))["n"]


def top(freq: Column, min_count: int) -> Column:
    """The most frequent feature with at least min_count uses, the first seen on a tie; else empty."""
    return let(F.filter(freq, lambda e: e["n"] >= min_count), lambda often: let(
        F.array_max(F.transform(often, lambda e: e["n"])),
        lambda most: F.coalesce(F.get(F.filter(often, lambda e: e["n"] == most), F.lit(0))["feature"], F.lit("")),
    ))


def prices(products: Column) -> Column:
    return F.filter(F.transform(products, lambda p: p["price"]), lambda v: v.isNotNull())


def ratings(products: Column) -> Column:
    return F.filter(F.transform(products, lambda p: p["avg_rating"]), lambda v: v.isNotNull())


def brands(products: Column) -> Column:
    """The named brands, repeats included."""
    return F.filter(F.transform(products, lambda p: p["brand"]), lambda b: F.length(b) > 0)


def repeated(values: Column, least: int = 2) -> Column:
    """The distinct values that occur at least `least` times, in order of first appearance."""
    return F.filter(
        F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)) >= least
    )


def point_between(values: Column, share: float) -> Column:
    """The point at a share of the range, null for no values."""
    return F.array_min(values) + (F.array_max(values) - F.array_min(values)) * F.lit(share)


def absent_partners(products: Column) -> Column:
    """(f1, partners): for each feature the later ones that share no product with it."""
    none = F.array().cast("array<string>")

    def partners(all_features: Column) -> Column:
        def of(f1: Column) -> Column:
            beside = F.flatten(F.transform(
                F.filter(products, lambda p: F.array_contains(F.coalesce(p["features"], none), f1)),
                lambda p: p["features"],
            ))
            later = F.filter(all_features, lambda f2: f2 > f1)
            return F.struct(f1.alias("f1"), F.array_except(later, beside).alias("partners"))

        return F.filter(F.transform(all_features, of), lambda e: F.size(e["partners"]) > 0)

    return let(F.array_sort(F.array_distinct(features_in(products))), partners)


def closest(
    products: Column, desired: Column, category: Column, price: Column, k: int = 2
) -> Column:
    """The k products nearest to a wish: shared features, same category, price distance, order."""
    none = F.array().cast("array<string>")

    def scored(p: Column, i: Column) -> Column:
        shared = F.size(F.array_intersect(desired, F.coalesce(p["features"], none)))
        same = F.when(p["category"] == category, 1).otherwise(0)
        away = F.abs(F.coalesce(p["price"], F.lit(0.0)) - price)
        return F.struct(
            (-shared).alias("shared"), (-same).alias("same"), away.alias("away"), i.alias("i"), p.alias("product")
        )

    ranked = F.transform(F.array_sort(F.transform(products, scored)), lambda s: s["product"])
    named = F.filter(ranked, lambda p: F.length(p["product_id"]) > 0)
    first = let(named, lambda ps: F.filter(
        ps, lambda p, i: F.array_position(ids(ps), p["product_id"]) == i + 1
    ))
    return F.slice(first, 1, k)


# ---- operators over context tables ---------------------------------------------------


def feature_freq(ctx: DataFrame) -> DataFrame:
    """(ctx_id, first_seen, feature, n)."""
    return ctx.select("ctx_id", F.posexplode(frequency(F.col("products"))).alias("first_seen", "e")).select(
        "ctx_id", "first_seen", "e.feature", "e.n"
    )


def draw_target(ctx: DataFrame, seed: int) -> DataFrame:
    """The contexts with one random product as `target`."""
    return ctx.withColumn("target", pick(F.col("products"), digest(seed, "target", F.col("ctx_id"))))


def rare_common(ctx: DataFrame) -> DataFrame:
    """The target's features that only it has (`rare`) and the others (`common`)."""
    ctx = ctx.withColumn("freq", frequency(F.col("products")))
    none = F.array().cast("array<string>")
    feats, freq = F.coalesce(F.col("target.features"), none), F.col("freq")
    return ctx.withColumns({
        "rare": F.filter(feats, lambda f: count_of(freq, f) == 1),
        "common": F.filter(feats, lambda f: count_of(freq, f) > 1),
    }).drop("freq")


def cooccurrence(ctx: DataFrame) -> DataFrame:
    """(ctx_id, f1, f2, n): products of a context that have both features, f1 < f2.

    The pairs of one product come from its own short feature list, inside the row.
    """
    none = F.array().cast("array<string>")

    def pairs(p: Column) -> Column:
        return let(F.array_sort(F.array_distinct(F.coalesce(p["features"], none))), lambda fs: F.flatten(
            F.transform(fs, lambda f1: F.transform(
                F.filter(fs, lambda f2: f2 > f1), lambda f2: F.struct(f1.alias("f1"), f2.alias("f2"))
            ))
        ))

    each = ctx.select("ctx_id", F.inline(F.flatten(F.transform("products", pairs))))
    return each.groupBy("ctx_id", "f1", "f2").agg(F.count(F.lit(1)).alias("n"))


def absent_pairs(ctx: DataFrame) -> DataFrame:
    """(ctx_id, f1, f2): features of a context that no product of it has together, f1 < f2."""
    return ctx.select("ctx_id", F.inline(absent_partners(F.col("products")))).select(
        "ctx_id", "f1", F.explode("partners").alias("f2")
    )


def diversity(ctx: DataFrame) -> DataFrame:
    """Brands and the price and rating ranges; 0.0 where nothing is known."""
    p = F.col("products")
    zero = F.lit(0.0)
    return ctx.select(
        "ctx_id",
        F.array_sort(F.array_distinct(brands(p))).alias("brands"),
        F.coalesce(F.array_min(prices(p)), zero).alias("min_price"),
        F.coalesce(F.array_max(prices(p)), zero).alias("max_price"),
        F.coalesce(F.array_min(ratings(p)), zero).alias("min_rating"),
        F.coalesce(F.array_max(ratings(p)), zero).alias("max_rating"),
    )


def top_feature(ctx: DataFrame, min_count: int = 2) -> DataFrame:
    return ctx.select("ctx_id", top(frequency(F.col("products")), min_count).alias("feature"))


def repeat_brands(ctx: DataFrame, least: int = 2) -> DataFrame:
    """(ctx_id, brand) for the brands of at least two products."""
    return ctx.select("ctx_id", F.explode(repeated(brands(F.col("products")), least)).alias("brand"))


def range_points(ctx: DataFrame) -> DataFrame:
    """A price at 70 % and a rating at 30 % of the range; 200 and null where nothing is known."""
    p = F.col("products")
    return ctx.select(
        "ctx_id",
        F.coalesce(point_between(prices(p), 0.7), F.lit(200.0)).alias("target_price"),
        point_between(ratings(p), 0.3).alias("rating_floor"),
    )


def satisfying_ids(ctx: DataFrame, cons: str = "constraint") -> DataFrame:
    """The contexts with the ids of the products that meet their constraint, in order."""
    return ctx.withColumn("satisfying_ids", ids(satisfying(F.col("products"), F.col(cons))))


def competitor_bounds(ctx: DataFrame, cons: str = "constraint") -> DataFrame:
    """The lowest price and the best rating among satisfying products other than the target."""
    target = F.col("target.product_id")
    others = F.filter(satisfying(F.col("products"), F.col(cons)), lambda p: p["product_id"] != target)
    return ctx.withColumn("others", others).withColumns({
        "min_price": F.array_min(prices(F.col("others"))),
        "max_rating": F.array_max(ratings(F.col("others"))),
    }).drop("others")


def closest_products(
    ctx: DataFrame, desired: str, category: str, price: str, k: int = 2
) -> DataFrame:
    """The contexts with the k products nearest to the desired columns as `closest`."""
    return ctx.withColumn(
        "closest", closest(F.col("products"), F.col(desired), F.col(category), F.col(price), k)
    )
