"""The product catalog: raw metadata to product rows and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aislekit.functions import products as P


def qa_to_pairs(df: DataFrame) -> DataFrame:
    """Questions and answers as user and assistant texts."""
    return df.select(F.col("query").alias("user"), F.col("answer").alias("assistant"))


def map_category(raw: DataFrame) -> DataFrame:
    """Raw rows of the five target categories, with the target as `category`.

    The fixed map is an IN test per target inside the scan stage; no join is needed.
    """
    return raw.withColumn("category", P.target_category(F.col("main_category"))).where(
        F.col("category").isNotNull()
    )


def extract_products(raw: DataFrame) -> DataFrame:
    """Product rows of raw metadata; rows without an id or a title are dropped."""
    return (
        map_category(raw)
        .where((F.length("parent_asin") > 0) & (F.length("title") > 0))
        .select(
            F.col("parent_asin").alias("product_id"),
            "category",
            P.sub_category(F.col("categories")).alias("sub_category"),
            "title",
            P.price_of(F.col("price")).alias("price"),
            P.brand_of(F.col("details")).alias("brand"),
            P.features_of(F.col("features")).alias("features"),
            F.col("average_rating").try_cast("double").alias("avg_rating"),
        )
    )


def format_context(df: DataFrame) -> DataFrame:
    """Product rows as tasks show them: the category is the slug of the sub-category."""
    return df.select(
        "product_id", P.slug(F.col("sub_category")).alias("category"), "title", "price", "brand", "features",
        "avg_rating",
    )


def category_map(library: DataFrame) -> DataFrame:
    """The distinct sub-categories of each category, sorted; empty names are left out."""
    named = library.where((F.length("category") > 0) & (F.length("sub_category") > 0))
    return named.groupBy("category").agg(F.array_sort(F.collect_set("sub_category")).alias("sub_categories"))


def category_counts(df: DataFrame) -> DataFrame:
    """Rows per category, sorted by name; a missing category counts as `unknown`."""
    category = F.coalesce(F.col("category"), F.lit("unknown")).alias("category")
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n_products")).orderBy("category")
