"""Catalog: scans, product columns, categories, quotas and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import schemas
from aislekit.functions import products as P
from aislekit.operators import catalog as O
from aislekit.plans import jobs
from aislekit.session import fresh_path
from aislekit.sources import jsonl, policy
from checks import base as B
from checks.base import check, using

_PRODUCT_SQL = """SELECT product_id, category, sub_category, title, round(price, 6) AS price, brand,
  array_to_string(features, '|') AS features, round(avg_rating, 6) AS avg_rating FROM library"""


def _product_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "product_id", "category", "sub_category", "title", F.round("price", 6).alias("price"), "brand",
        F.array_join("features", "|").alias("features"), F.round("avg_rating", 6).alias("avg_rating"),
    )


@check("product_library", using("library", _PRODUCT_SQL))
def product_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_rows(B.library(spark, sf_dir))


@check("raw_meta_scan", using("raw_meta", """
SELECT parent_asin, main_category, coalesce(title, '') AS title, price,
  CASE WHEN json_valid(details) THEN json_extract_string(details, '$.Color') END AS color FROM raw_meta"""))
def raw_meta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as gzip lines with blank and broken ones between them, then scanned."""
    rows = B.raw_meta(spark, sf_dir)
    path = fresh_path(spark, "raw-meta")
    line = F.to_json(F.struct(*rows.columns))
    lines = rows.select(F.explode(F.array(line, F.lit(""), F.lit('{"parent_asin": "cut'))).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    scanned = jsonl.read_raw_meta(spark, [path + "-absent", path])
    return scanned.select(
        "parent_asin", "main_category", F.coalesce("title", F.lit("")).alias("title"), "price",
        F.get_json_object("details", "$.Color").alias("color"),
    )


_PLANTED = ("planted", """SELECT doc_id, lang, CASE doc_id % 9 WHEN 4 THEN concat('{"doc_id":', doc_id) WHEN 5 THEN '[1, 2]' WHEN 6 THEN 'null'
  WHEN 7 THEN '   ' WHEN 8 THEN '{"doc_id":"seven","lang":3}' ELSE to_json({'doc_id': doc_id, 'lang': lang})::VARCHAR END AS line FROM documents""")


def _planted_lines(spark: SparkSession, sf_dir: str) -> str:
    """Documents as lines, some of them cut, no objects, blank, or with fields of other types."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang")
    kind = F.col("doc_id") % 9
    line = F.when(kind == 4, F.concat(F.lit('{"doc_id":'), F.col("doc_id"))).when(kind == 5, "[1, 2]").when(kind == 6, "null").when(
        kind == 7, "   ").when(kind == 8, '{"doc_id":"seven","lang":3}').otherwise(F.to_json(F.struct("doc_id", "lang")))
    path = fresh_path(spark, "planted")
    docs.select(F.floor(F.col("doc_id") / 40).alias("part"), "doc_id", line.alias("value")).repartition("part").sortWithinPartitions(
        "part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return path


@check("rejected_lines", B.chain("""SELECT doc_id // 40 AS part, row_number, line FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS row_number FROM planted)
  WHERE doc_id % 9 IN (4, 5, 6)""", _PLANTED))
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jsonl.rejected_lines(spark, _planted_lines(spark, sf_dir), "doc_id bigint, lang string")
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint")
    return found.select(part.alias("part"), F.col("line_no").alias("row_number"), "line")


@check("lenient_scan", B.chain("""SELECT CASE WHEN doc_id % 9 < 8 THEN doc_id END AS doc_id, CASE WHEN doc_id % 9 < 8 THEN planted.lang ELSE '3' END AS lang
  FROM planted WHERE doc_id % 9 NOT IN (4, 5, 6, 7)""", _PLANTED))
def lenient_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.read_jsonl(spark, _planted_lines(spark, sf_dir), "doc_id bigint, lang string", strict=False)


@check("capped_meta", using("raw_meta", "SELECT parent_asin, title FROM raw_meta ORDER BY parent_asin LIMIT 150"))
def capped_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 readable lines of several files, after a source that is cut short."""
    rows = B.raw_meta(spark, sf_dir)
    line = F.to_json(F.struct(*rows.columns))
    path, cut = fresh_path(spark, "raw-meta"), fresh_path(spark, "raw-meta-cut")
    lines = rows.orderBy("parent_asin").select(F.explode(F.array(line, F.lit('{"parent_asin": "cut'))).alias("value"))
    lines.write.text(path)
    # no gzip data under the name of some
    B.table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).coalesce(1).write.text(cut + "/plain")
    _renamed(spark, cut + "/plain", cut + "/meta.jsonl.gz")
    return jsonl.read_raw_meta(spark, [cut + "/meta.jsonl.gz", path], 150).select("parent_asin", "title")


def _renamed(spark: SparkSession, folder: str, path: str) -> None:
    """The one file of a folder under another name."""
    source = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(path))


@check("jsonl_round_trip", using("library", _PRODUCT_SQL))
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "library")
    jsonl.write_jsonl(B.library(spark, sf_dir), path)
    return _product_rows(jsonl.read_jsonl(spark, path, schemas.PRODUCT))


@check("policy_scan", using("shipping", """
SELECT category, standard_days, express_days, overnight_days, standard_cost, express_cost, overnight_cost
FROM shipping WHERE length(category) > 0
QUALIFY row_number() OVER (PARTITION BY category ORDER BY line_no DESC) = 1"""))
def policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipping, _ = B.policies(spark, sf_dir)
    path = fresh_path(spark, "shipping")
    jsonl.write_jsonl(shipping, path)
    return policy.load_policy(jsonl.read_jsonl(spark, path, schemas.SHIPPING))


@check("category_membership", using("raw_meta", f"""
SELECT parent_asin, {B._category_case('main_category')} AS category FROM raw_meta
WHERE {B._category_case('main_category')} IS NOT NULL"""))
def category_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.map_category(B.raw_meta(spark, sf_dir)).select("parent_asin", "category")


@check("raw_columns", using("raw_meta", """
SELECT parent_asin,
  CASE WHEN json_array_length(categories) = 0 THEN ''
    WHEN json_type(categories, '$[0]') = 'ARRAY' AND json_array_length(categories, '$[0]') > 0
      THEN json_extract_string(categories, '$[0][#-1]')
    ELSE json_extract_string(categories, '$[#-1]') END AS sub_category,
  CASE WHEN json_type(features) = 'ARRAY' THEN json_array_length(features)::BIGINT ELSE 0 END AS n_features,
  round(TRY_CAST(price AS DOUBLE), 6) AS price,
  CASE WHEN details IS NULL OR NOT json_valid(details) THEN ''
    ELSE coalesce(details ->> 'Brand', details ->> 'brand') END AS brand
FROM raw_meta"""))
def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.raw_meta(spark, sf_dir).select(
        "parent_asin",
        P.sub_category(F.col("categories")).alias("sub_category"),
        F.size(P.features_of(F.col("features"))).cast("bigint").alias("n_features"),
        F.round(P.price_of(F.col("price")), 6).alias("price"),
        P.brand_of(F.col("details")).alias("brand"),
    )


@check("context_projection", using("library", """
SELECT product_id, replace(lower(sub_category), ' ', '_') AS category, title, round(price, 6) AS price, brand,
  len(features)::BIGINT AS n_features, round(avg_rating, 6) AS avg_rating FROM library"""))
def context_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.format_context(B.library(spark, sf_dir)).select(
        "product_id", "category", "title", F.round("price", 6).alias("price"), "brand",
        F.size("features").cast("bigint").alias("n_features"), F.round("avg_rating", 6).alias("avg_rating"),
    )


@check("product_texts", using("library", """
SELECT product_id, concat(title, ' ', brand, ' ', category, ' ', sub_category, ' $',
  coalesce(price::VARCHAR, 'None'), ' ', array_to_string(features, ' ')) AS product_text FROM library"""))
def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.library(spark, sf_dir)
    return df.select("product_id", P.product_text({c: F.col(c) for c in df.columns}).alias("product_text"))


_FEATURE_PHRASE = """CASE len(features) WHEN 0 THEN {default} WHEN 1 THEN concat('features ', features[1])
  WHEN 2 THEN concat('features ', features[1], ' and ', features[2])
  ELSE concat('features ', array_to_string(features[:-2], ', '), ', and ', features[-1]) END"""


def line_sql(p: str, style: str) -> str:
    """The sentence on a product, for columns with the prefix p."""
    phrase = _FEATURE_PHRASE.replace("features[", f"{p}features[").replace("len(features)", f"len({p}features)")
    if style == "list":
        return (
            f"concat('the ', {p}title, ' from ', {p}brand, ' ($', printf('%.2f', coalesce({p}price, 0.0)::DOUBLE), ', ', "
            f"printf('%.1f', coalesce({p}avg_rating, 4.0)::DOUBLE), ' stars) which ', "
            + phrase.format(default="'is a quality product'") + ")"
        )
    return (
        f"concat('- ', {p}title, ' by ', {p}brand, ' ($', printf('%.2f', coalesce({p}price, 0.0)::DOUBLE), ', ', "
        f"printf('%.1f', coalesce({p}avg_rating, 0.0)::DOUBLE), ' stars), which ', "
        + phrase.format(default="'is a solid option'") + ", '.')"
    )


@check("product_lines", using("library", f"""
SELECT product_id, {_FEATURE_PHRASE.format(default="'nothing'")} AS phrase,
  {line_sql('', 'list')} AS list_line, {line_sql('', 'reject')} AS reject_line FROM library"""))
def product_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.library(spark, sf_dir)
    p = {c: F.col(c) for c in df.columns}
    return df.select(
        "product_id", P.feature_phrase(F.col("features"), "nothing").alias("phrase"),
        P.product_line(p, "list").alias("list_line"), P.product_line(p, "reject").alias("reject_line"),
    )


@check("category_map", using("library", """
SELECT category, array_to_string(list_sort(list(DISTINCT sub_category)), '|') AS sub_categories
FROM library WHERE length(category) > 0 AND length(sub_category) > 0 GROUP BY category"""))
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.category_map(B.library(spark, sf_dir)).select(
        "category", F.array_join("sub_categories", "|").alias("sub_categories")
    )


@check("category_counts", using("raw_meta", f"""
SELECT coalesce({B._category_case('main_category')}, 'unknown') AS category, count(*) AS n_products
FROM raw_meta GROUP BY 1"""))
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.raw_meta(spark, sf_dir)
    return O.category_counts(df.select(P.target_category(F.col("main_category")).alias("category")))


_QUOTA = 5 * 100


@check("quota_library", using("library", f"""
SELECT category, product_id, title FROM library
QUALIFY row_number() OVER (PARTITION BY category ORDER BY {B.digest('quota', 'product_id')}, product_id) <= {_QUOTA // 5}
"""))
def quota_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = jobs.curate_library(B.raw_meta(spark, sf_dir), _QUOTA, B.SEED)
    return kept.select("category", "product_id", "title")


@check("library_in_parts", B.ORACLES["quota_library"])
def library_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same library out of three deliveries of raw metadata, the last one first."""
    raw, path = B.raw_meta(spark, sf_dir), fresh_path(spark, "library")
    part = F.pmod(F.crc32(F.col("parent_asin").cast("binary")), F.lit(3))
    for i in (2, 0, 1):
        kept = jobs.update_library(raw.where(part == i), path, _QUOTA, B.SEED)
    return kept.select("category", "product_id", "title")


@check("balanced_catalog", using("library", f"""
SELECT category, count(*) AS n_products FROM (
  SELECT category FROM library
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY {B.digest('quota', 'product_id')}, product_id) <= {_QUOTA // 5})
GROUP BY category"""))
def balanced_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.category_counts(jobs.curate_library(B.raw_meta(spark, sf_dir), _QUOTA, B.SEED))


@check("qa_pairs", """
SELECT u.text AS "user", a.text AS assistant FROM conversations u JOIN conversations a
ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = B.table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return O.qa_to_pairs(asked.join(told, ["conv_id", "turn"]))
