"""The four task generators. Their SQL works on product rows, one join per step."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import vocabulary as V
from aislekit.plans import tasks as T
from checks import base as B
from checks.base import check, choose, digest, index, pick, text, uniform, unit, using
from checks.catalog import line_sql
from checks.contexts import _FREQ, _PAIRS, _RANGES, _TARGET, _USES, phrase_sql


# Per kind the select and the tables before it, which start from product rows `ctxp`.
TASK_SQL: dict[str, tuple[str, list[tuple[str, str]]]] = {}


def shuffled(values: str, salt: str, key: str = "ctx_id") -> str:
    place = digest(salt, key, "i - 1")
    return (
        f"list_transform(list_sort(list_transform({values}, lambda x, i: {{'o': {place}, 'v': x}})), lambda e: e.v)"
    )


def fill(template: str, values: dict[str, str]) -> str:
    parts = []
    for words, name, _, _ in Formatter().parse(template):
        if words:
            parts.append(text(words))
        if name:
            parts.append(values[name])
    return "concat(" + ", ".join(parts) + ")"


def fill_one(templates: list[str], salt: str, values: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {fill(t, values)}" for i, t in enumerate(templates))
    return f"CASE {index(digest(salt, 'ctx_id'), str(len(templates)))} {arms} END"


def join_last(values: str, sep: str, last: str) -> str:
    return (
        f"CASE WHEN len({values}) = 0 THEN '' WHEN len({values}) = 1 THEN ({values})[1] "
        f"ELSE concat(array_to_string(({values})[:-2], '{sep}'), '{last}', ({values})[-1]) END"
    )


_MATCH = """(s.max_price IS NULL OR p.price IS NULL OR p.price <= s.max_price)
  AND (coalesce(s.brand, '') = '' OR p.brand = s.brand)
  AND len(list_filter(s.feats, lambda f: NOT list_contains(p.features, f))) = 0
  AND (s.min_rating IS NULL OR p.avg_rating IS NULL OR p.avg_rating >= s.min_rating)"""


def _met(name: str, state: str) -> tuple[str, str]:
    """The products that meet the constraints of a state table, one row per context."""
    return (name, f"""SELECT s.ctx_id, count(p.product_id) AS n,
      coalesce(list(p.product_id ORDER BY p.pos) FILTER (p.product_id IS NOT NULL), []) AS ids
      FROM {state} s LEFT JOIN ctxp p ON p.ctx_id = s.ctx_id AND {_MATCH} GROUP BY s.ctx_id""")


def _changed(by: dict[str, dict[str, str]]) -> str:
    """The next state: per column what each action sets it to."""
    columns = []
    for column in ("max_price", "brand", "feats", "min_rating"):
        arms = " ".join(f"WHEN '{a}' THEN {sets[column]}" for a, sets in by.items() if column in sets)
        columns.append(f"CASE action {arms} ELSE {column} END AS {column}" if arms else column)
    return ", ".join(columns)


# ---- pick one ---------------------------------------------------------------------------

_TRAITS = ("traits", """SELECT t.ctx_id, t.product_id, t.category, t.price, t.brand, t.avg_rating, t.features,
    coalesce(list(u.feature ORDER BY u.i) FILTER (f.n = 1), []) AS rare,
    coalesce(list(u.feature ORDER BY u.i) FILTER (f.n > 1), []) AS common
  FROM target t LEFT JOIN uses u ON u.ctx_id = t.ctx_id AND u.pos = t.pos
  LEFT JOIN freq f ON f.ctx_id = u.ctx_id AND f.feature = u.feature GROUP BY ALL""")


def _one_step(i: int) -> list[tuple[str, str]]:
    before, free = f"one{i - 1}", "len(list_filter({0}, lambda f: NOT list_contains(s.feats, f))) > 0"
    rest = "list_filter({0}, lambda f: NOT list_contains(s.feats, f))"
    pool = f"CASE WHEN {free.format('t.rare')} THEN {rest.format('t.rare')} ELSE {rest.format('t.common')} END"
    facts = f"""SELECT s.ctx_id, s.max_price, s.brand, s.feats, s.min_rating, t.product_id, t.price, t.brand AS t_brand,
        t.avg_rating, t.features, {pool} AS pool, count(p.product_id) AS n,
        coalesce(bool_and(p.product_id = t.product_id), FALSE) AS only_target,
        min(p.price) FILTER (p.product_id <> t.product_id) AS min_other,
        max(p.avg_rating) FILTER (p.product_id <> t.product_id) AS max_other
      FROM {before} s JOIN traits t ON t.ctx_id = s.ctx_id LEFT JOIN ctxp p ON p.ctx_id = s.ctx_id AND {_MATCH} GROUP BY ALL"""
    acted = f"""SELECT *, CASE WHEN n = 1 AND only_target THEN 'keep' WHEN n > 1 AND len(pool) > 0 THEN 'feature'
        WHEN n > 1 AND coalesce(brand, '') = '' AND t_brand <> '' THEN 'brand'
        WHEN n > 1 AND price IS NOT NULL AND min_other IS NOT NULL
          AND least(min_other - 0.01::DOUBLE, price + 0.001::DOUBLE) >= price THEN 'ceiling'
        WHEN n > 1 AND avg_rating IS NOT NULL AND max_other IS NOT NULL THEN 'floor'
        WHEN n > 1 THEN 'all' WHEN min_rating IS NOT NULL THEN 'unrate' ELSE 'raise' END AS action FROM ({facts})"""
    step = _changed({
        "feature": {"feats": f"list_append(feats, {pick('pool', digest('one-feature', 'ctx_id', str(i)))})"},
        "brand": {"brand": "t_brand"},
        "ceiling": {"max_price": "least(min_other - 0.01::DOUBLE, price + 0.001::DOUBLE)"},
        "floor": {"min_rating": "least(avg_rating, max_other + 0.001::DOUBLE)"},
        "all": {
            "brand": "CASE WHEN t_brand <> '' THEN t_brand ELSE brand END",
            "feats": "CASE WHEN len(feats) < len(features) THEN list_distinct(features) ELSE feats END",
        },
        "unrate": {"min_rating": "NULL"},
        "raise": {"max_price": "max_price + 10.0::DOUBLE"},
    })
    return [(f"one{i}", f"SELECT ctx_id, {step} FROM ({acted})")]


_FIRST = digest("one-feature", "ctx_id", "0")
_ONE = [
    _USES, _FREQ, _TARGET, _TRAITS,
    ("one0", f"""SELECT ctx_id, price + {uniform(digest('one-price', 'ctx_id'), 5, 25)} AS max_price, NULL::VARCHAR AS brand,
      CASE WHEN len(rare) > 0 THEN [{pick('rare', _FIRST)}] WHEN len(common) > 0 THEN [{pick('common', _FIRST)}]
        ELSE []::VARCHAR[] END AS feats, NULL::DOUBLE AS min_rating FROM traits"""),
    *[part for i in range(1, 7) for part in _one_step(i)],
    _met("one_met", "one6"),
    ("one_state", """SELECT s.ctx_id, single,
        CASE WHEN single OR t.price IS NULL THEN s.max_price ELSE t.price + 0.001::DOUBLE END AS max_price,
        CASE WHEN single THEN s.brand ELSE t.brand END AS brand,
        CASE WHEN single THEN s.feats ELSE list_distinct(t.features) END AS feats, s.min_rating, t.category, t.product_id
      FROM (SELECT s.*, m.n = 1 AND list_contains(m.ids, t.product_id) AS single FROM one6 s JOIN one_met m USING (ctx_id)
        JOIN traits t USING (ctx_id)) s JOIN traits t USING (ctx_id)"""),
    _met("one_final", "one_state"),
]


TASK_SQL["pick_one"] = ("""
SELECT s.ctx_id, 'pick_one' AS task, array_to_string(m.ids, '|') AS satisfying_ids,
  concat('Need a ', replace(s.category, '_', ' '),
    CASE WHEN max_price IS NULL THEN '' ELSE concat(' under $', floor(max_price)::BIGINT) END,
    CASE WHEN coalesce(brand, '') = '' THEN '' ELSE concat(' from ', brand) END,
    CASE WHEN len(feats) = 0 THEN '' ELSE concat(' with ', array_to_string(list_sort(feats), ', ')) END,
    CASE WHEN min_rating IS NULL THEN '' ELSE concat(' with rating at least ', printf('%.1f', min_rating)) END, '.') AS query
FROM one_state s JOIN one_final m USING (ctx_id)""", _ONE)


@check("pick_one_tasks", using("ctxp", TASK_SQL["pick_one"][0], *_ONE))
def pick_one_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.pick_one(B.contexts(spark, sf_dir), B.SEED)
    return made.select("ctx_id", "task", F.array_join("satisfying_ids", "|").alias("satisfying_ids"), "query")


# ---- pick list --------------------------------------------------------------------------

_OFTEN = f"""SELECT ctx_id, list(feature ORDER BY {digest('list-feature', 'ctx_id', 'i')}) AS often FROM (
  SELECT ctx_id, feature, row_number() OVER (PARTITION BY ctx_id ORDER BY place) - 1 AS i FROM freq WHERE n >= 2) GROUP BY ctx_id"""
_TWICE = """SELECT ctx_id, list(brand ORDER BY place) AS twice FROM (
  SELECT ctx_id, brand, min(pos) AS place FROM ctxp WHERE length(brand) > 0 GROUP BY ctx_id, brand HAVING count(*) >= 2) GROUP BY ctx_id"""


def _list_step(i: int) -> tuple[str, str]:
    step = _changed({
        "unrate": {"min_rating": "NULL"},
        "unbrand": {"brand": "NULL"},
        "keep one": {"feats": f"[{pick('feats', digest('list-keep', 'ctx_id', str(i)))}]"},
        "no feature": {"feats": "[]"},
        "raise": {"max_price": "max_price + 100.0::DOUBLE"},
    })
    return (f"list{i}", f"""SELECT ctx_id, {step} FROM (
      SELECT *, CASE WHEN n >= 2 THEN 'keep' WHEN min_rating IS NOT NULL THEN 'unrate' WHEN brand IS NOT NULL THEN 'unbrand'
        WHEN len(feats) > 1 THEN 'keep one' WHEN len(feats) = 1 THEN 'no feature' ELSE 'raise' END AS action FROM (
        SELECT s.ctx_id, s.max_price, s.brand, s.feats, s.min_rating, count(p.product_id) AS n FROM list{i - 1} s
        LEFT JOIN ctxp p ON p.ctx_id = s.ctx_id AND {_MATCH} GROUP BY ALL))""")


_WISHES = f"""list_filter([concat('under $', floor(max_price)::BIGINT), CASE WHEN coalesce(brand, '') <> '' THEN concat('from ', brand) END,
  CASE WHEN len(feats) > 0 THEN concat('with ', array_to_string(list_sort(feats), ', ')) END,
  CASE WHEN min_rating IS NOT NULL THEN concat('rating at least ', printf('%.1f', min_rating)) END], lambda w: w IS NOT NULL)"""
_LIST = [
    _USES, _FREQ, _RANGES, ("often", _OFTEN), ("twice", _TWICE),
    ("list0", f"""SELECT r.ctx_id, coalesce(low + (high - low) * 0.7::DOUBLE, 200.0)
        + {uniform(digest('list-price', 'r.ctx_id'), 20, 100)} AS max_price,
      CASE WHEN {unit(digest('list-brand', 'r.ctx_id'))} < 0.3::DOUBLE THEN {pick('twice', digest('list-which-brand', 'r.ctx_id'))} END AS brand,
      coalesce(often[1:1 + {index(digest('list-feature-count', 'r.ctx_id'), '2')}], []::VARCHAR[]) AS feats,
      CASE WHEN {unit(digest('list-rating', 'r.ctx_id'))} < 0.4::DOUBLE THEN rating_low + (rating_high - rating_low) * 0.3::DOUBLE END AS min_rating
      FROM ranges r LEFT JOIN often USING (ctx_id) LEFT JOIN twice USING (ctx_id)"""),
    *[_list_step(i) for i in range(1, 11)],
    _met("list_met", "list10"),
    ("list_state", """SELECT s.ctx_id, CASE WHEN m.n >= 2 THEN s.max_price ELSE z.max_price + 200.0::DOUBLE END AS max_price,
        CASE WHEN m.n >= 2 THEN s.brand END AS brand, CASE WHEN m.n >= 2 THEN s.feats ELSE [] END AS feats,
        CASE WHEN m.n >= 2 THEN s.min_rating END AS min_rating
      FROM list10 s JOIN list_met m USING (ctx_id) JOIN list0 z USING (ctx_id)"""),
    _met("list_final", "list_state"),
    ("phrases", phrase_sql("list-item", "product")),
    ("asked", f"""SELECT *, trim({fill_one(V.PICK_LIST_STYLES, 'list-style', {'item': 'phrase', 'rest': 'rest'})}) AS q FROM (
      SELECT *, CASE WHEN len(ws) = 0 THEN '' ELSE concat(' ', {join_last('ws', ', ', ' and ')}) END AS rest FROM (
        SELECT ctx_id, phrase, {shuffled(_WISHES, 'list-wishes')} AS ws FROM list_state JOIN phrases USING (ctx_id)))"""),
    ("told", f"""SELECT ctx_id, list({line_sql('p.', 'list')} ORDER BY coalesce(p.price, 0.0), p.pos) AS lines
      FROM list_final m JOIN ctxp p USING (ctx_id) WHERE list_contains(m.ids, p.product_id) GROUP BY ctx_id"""),
]


TASK_SQL["pick_list"] = (f"""
SELECT ctx_id, 'pick_list' AS task, CASE WHEN ends_with(q, '?') OR ends_with(q, '.') THEN q ELSE concat(q, '.') END AS query,
  array_to_string(m.ids, '|') AS predicted_ids,
  {fill_one(V.PICK_LIST_REPLIES, 'list-reply', {'count': 'len(coalesce(lines, []))', 'product_recommendations': join_last("coalesce(lines, [])", ', ', ', and ')})} AS reply
FROM asked JOIN list_final m USING (ctx_id) LEFT JOIN told USING (ctx_id)""", _LIST)


@check("pick_list_tasks", using("ctxp", TASK_SQL["pick_list"][0], *_LIST))
def pick_list_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.pick_list(B.contexts(spark, sf_dir), B.SEED)
    return made.select("ctx_id", "task", "query", F.array_join("predicted_ids", "|").alias("predicted_ids"), "reply")


# ---- reject -----------------------------------------------------------------------------


def _below(salt: str, low: float, high: float, *more: str) -> str:
    return f"greatest(0.0::DOUBLE, min_price - {uniform(digest(salt, 'ctx_id', *more), low, high)})"


def _above(salt: str, *more: str) -> str:
    return f"max_rating + {uniform(digest(salt, 'ctx_id', *more), 0.1, 0.5)}"


def _reject_step(i: int) -> tuple[str, str]:
    step = _changed({
        "lower": {"max_price": _below("reject-lower", 1, 20, str(i))},
        "higher": {"min_rating": _above("reject-higher", str(i))},
        "feature": {"feats": f"list_append(feats, {pick('free', digest('reject-feature', 'ctx_id', str(i)))})"},
        "brand": {"brand": pick("foreign_brands", digest("reject-brand", "ctx_id", str(i)))},
    })
    return (f"reject{i}", f"""SELECT ctx_id, {step}, min_price, max_rating, rated, all_feats, foreign_brands FROM (
      SELECT *, CASE WHEN n = 0 THEN 'keep' WHEN max_price IS NULL THEN 'lower' WHEN min_rating IS NULL AND rated THEN 'higher'
        WHEN len(free) > 0 THEN 'feature' ELSE 'brand' END AS action FROM (
        SELECT s.*, list_filter(s.all_feats, lambda f: NOT list_contains(s.feats, f)) AS free, count(p.product_id) AS n
        FROM reject{i - 1} s LEFT JOIN ctxp p ON p.ctx_id = s.ctx_id AND {_MATCH} GROUP BY ALL))""")


_FOREIGN = "[" + ", ".join(text(b) for b in V.FOREIGN_BRANDS) + "]"
_REJECT = [
    _USES, _FREQ, _PAIRS, _RANGES,
    ("absent", """SELECT a.ctx_id, list({'f1': a.feature, 'f2': b.feature} ORDER BY a.feature, b.feature) AS all_pairs
      FROM freq a JOIN freq b ON a.ctx_id = b.ctx_id AND a.feature < b.feature
      ANTI JOIN pairs p ON p.ctx_id = a.ctx_id AND p.f1 = a.feature AND p.f2 = b.feature GROUP BY a.ctx_id"""),
    ("own", """SELECT ctx_id, coalesce(list(DISTINCT brand) FILTER (length(brand) > 0), []) AS brands FROM ctxp GROUP BY ctx_id"""),
    ("all_feats", "SELECT ctx_id, list(feature ORDER BY place) AS all_feats FROM freq GROUP BY ctx_id"),
    ("base", f"""SELECT r.ctx_id, coalesce(low, 0.0) AS min_price, coalesce(rating_high, 5.0) AS max_rating,
        rating_high IS NOT NULL AS rated, coalesce(all_feats, []::VARCHAR[]) AS all_feats,
        {pick('all_pairs', digest('reject-pair', 'r.ctx_id'))} AS pair,
        CASE WHEN len(list_filter({_FOREIGN}, lambda b: NOT list_contains(brands, b))) > 0
          THEN list_filter({_FOREIGN}, lambda b: NOT list_contains(brands, b)) ELSE {_FOREIGN} END AS foreign_brands
      FROM ranges r JOIN own USING (ctx_id) LEFT JOIN all_feats USING (ctx_id) LEFT JOIN absent USING (ctx_id)"""),
    ("reject0", f"""SELECT ctx_id, CASE WHEN pair IS NULL THEN {_below('reject-price', 5, 30)} END AS max_price, NULL::VARCHAR AS brand,
        CASE WHEN pair IS NULL THEN []::VARCHAR[] ELSE [pair.f1, pair.f2] END AS feats,
        CASE WHEN {unit(digest('reject-rated', 'ctx_id'))} < 0.5::DOUBLE THEN {_above('reject-rating')} END AS min_rating,
        min_price, max_rating, rated, all_feats, foreign_brands FROM base"""),
    *[_reject_step(i) for i in range(1, 7)],
    _met("reject_met", "reject6"),
    ("reject_state", """SELECT ctx_id, brand, feats, coalesce(max_price, floor(min_price)) AS max_price, min_rating FROM (
      SELECT s.ctx_id, s.brand, s.feats, s.min_price,
        CASE WHEN m.n = 0 THEN s.max_price ELSE greatest(0.0::DOUBLE, s.min_price - 0.01::DOUBLE) END AS max_price,
        CASE WHEN m.n = 0 THEN s.min_rating ELSE s.max_rating + 0.1::DOUBLE END AS min_rating
      FROM reject6 s JOIN reject_met m USING (ctx_id))"""),
    ("phrases", phrase_sql("reject-item", "blender")),
    ("nearest", f"""SELECT ctx_id, string_agg(line, chr(10) ORDER BY rank) AS lines FROM (
      SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY shared DESC, same DESC, away, pos) AS rank FROM (SELECT * FROM (
        SELECT p.ctx_id, p.pos, p.product_id, {line_sql('p.', 'reject')} AS line, p.category = h.category AS same,
          len(list_filter(s.feats, lambda f: list_contains(p.features, f))) AS shared,
          abs(coalesce(p.price, 0.0) - s.max_price) AS away
        FROM ctxp p JOIN reject_state s USING (ctx_id) JOIN ctxp h ON h.ctx_id = p.ctx_id AND h.pos = 0)
      QUALIFY row_number() OVER (PARTITION BY ctx_id, product_id ORDER BY shared DESC, same DESC, away, pos) = 1))
      WHERE rank <= 2 GROUP BY ctx_id"""),
]
_REJECT_VALUES = {
    "item": "phrase",
    "price": "floor(max_price)::BIGINT",
    "feat_clause": f"CASE WHEN len(feats) = 0 THEN '' ELSE concat(' with ', {join_last('list_sort(feats)', ', ', ' and ')}) END",
    "brand_clause": "CASE WHEN coalesce(brand, '') = '' THEN '' ELSE concat(' from ', brand) END",
    "rating_clause": "CASE WHEN min_rating <= 5.0 THEN concat(' with rating at least ', printf('%.1f', min_rating)) ELSE '' END",
}


TASK_SQL["reject"] = (f"""
SELECT ctx_id, 'reject' AS task, concat(trim({fill_one(V.REJECT_STYLES, 'reject-style', _REJECT_VALUES)}), '.') AS query,
  '' AS predicted_ids, concat_ws(chr(10), {choose(V.REJECT_OPENERS, digest('reject-opener', 'ctx_id'))},
    {choose(V.REJECT_SEGUES, digest('reject-segue', 'ctx_id'))}, lines) AS reply
FROM reject_state JOIN phrases USING (ctx_id) JOIN nearest USING (ctx_id)""", _REJECT)


@check("reject_tasks", using("ctxp", TASK_SQL["reject"][0], *_REJECT))
def reject_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.reject(B.contexts(spark, sf_dir), B.SEED)
    return made.select("ctx_id", "task", "query", F.array_join("predicted_ids", "|").alias("predicted_ids"), "reply")


# ---- clarify ----------------------------------------------------------------------------

_SLOTS = """list_filter([CASE WHEN high - low >= 80.0 THEN 'budget' END, CASE WHEN common <> '' THEN 'feature' END,
  CASE WHEN n_brands >= 2 THEN 'brand' END], lambda s: s IS NOT NULL)"""
_MIDDLE = "CASE WHEN high <> 0 THEN (floor((low + high) / 2)::BIGINT)::VARCHAR ELSE '100' END"
_BUDGET = fill(V.BUDGET_QUESTION, {"mid": _MIDDLE})
_TOPICS = ", ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM uses u WHERE u.ctx_id = o.ctx_id AND ("
    + " OR ".join(f"contains(lower(u.feature), {text(w)})" for w in words) + f")) THEN {text(question)} END"
    for words, question in V.TOPIC_QUESTIONS
)


def _more(limit: int, condition: str, question: str) -> str:
    return f"CASE WHEN len(qs) < {limit} AND {condition} THEN list_append(qs, {question}) ELSE qs END AS qs"


_BROAD = "(high - low >= 20.0 OR rating_high - rating_low >= 0.4)"
_CLARIFY = [
    _USES, _FREQ,
    ("open", f"""SELECT o.*, {shuffled(f'list_filter([{_TOPICS}], lambda q: q IS NOT NULL)', 'clarify-topics', 'o.ctx_id')} AS topics FROM (
      SELECT *, slots[1:1 + {index(digest('clarify-count', 'ctx_id'), 'least(greatest(len(slots), 1), 2)')}] AS chosen FROM (
        SELECT *, {shuffled(_SLOTS, 'clarify-slots')} AS slots FROM (
          SELECT c.ctx_id, coalesce(min(price), 0.0) AS low, coalesce(max(price), 0.0) AS high,
            coalesce(min(avg_rating), 0.0) AS rating_low, coalesce(max(avg_rating), 0.0) AS rating_high,
            count(DISTINCT brand) FILTER (length(brand) > 0) AS n_brands,
            coalesce((SELECT feature FROM freq f WHERE f.ctx_id = c.ctx_id AND n >= 2 ORDER BY n DESC, place LIMIT 1), '') AS common,
            coalesce((SELECT feature FROM freq f WHERE f.ctx_id = c.ctx_id ORDER BY place LIMIT 1), '') AS any_feature
          FROM ctxp c GROUP BY c.ctx_id))) o"""),
    ("slotted", """SELECT *, len(chosen) = 0 OR list_contains(chosen, 'budget') AS ask_budget,
      CASE WHEN len(chosen) = 0 THEN any_feature WHEN list_contains(chosen, 'feature') THEN common ELSE '' END AS feature,
      list_contains(chosen, 'brand') AS ask_brand FROM open"""),
    ("q0", f"""SELECT *, list_filter([CASE WHEN ask_budget AND high - low >= 20.0 THEN {_BUDGET} END,
      CASE WHEN feature <> '' THEN {fill(V.FEATURE_QUESTION, {'feature': 'feature'})} END,
      CASE WHEN ask_brand AND n_brands >= 2 THEN {text(V.BRAND_QUESTION)} END], lambda q: q IS NOT NULL) AS qs FROM slotted"""),
    ("q1", "SELECT * REPLACE (list_concat(qs, topics[1:greatest(3 - len(qs), 0)]) AS qs) FROM q0"),
    ("q2", f"SELECT * REPLACE ({_more(3, _BROAD, text(V.TRADE_OFF_QUESTION))}) FROM q1"),
    ("q3", f"SELECT * REPLACE ({_more(3, 'NOT (ask_brand AND n_brands >= 2) AND n_brands >= 2', text(V.BRAND_OPEN_QUESTION))}) FROM q2"),
    ("q4", "SELECT * REPLACE (" + _more(
        2, "high - low >= 20.0 AND len(list_filter(qs, lambda q: contains(q, 'budget cap'))) = 0", _BUDGET) + ") FROM q3"),
    ("q5", "SELECT * REPLACE (" + _more(
        2, "rating_high - rating_low >= 0.4 AND len(list_filter(qs, lambda q: contains(q, 'prioritizing'))) = 0",
        text(V.TRADE_OFF_QUESTION)) + ") FROM q4"),
    ("phrases", phrase_sql("clarify-item", "blender")),
]
_CLARIFY_VALUES = {
    "item": "phrase",
    "feat_hint": "CASE WHEN feature = '' THEN '' ELSE concat(' with ', feature, ' (if that''s worth it)') END",
    "brand_hint": "CASE WHEN ask_brand THEN ' Any brand is fine, I think.' ELSE '' END",
}


TASK_SQL["clarify"] = (f"""
SELECT ctx_id, 'clarify' AS task, trim({fill_one(V.CLARIFY_STYLES, 'clarify-style', _CLARIFY_VALUES)}) AS query,
  concat({choose(V.CLARIFY_OPENINGS, digest('clarify-opening', 'ctx_id'))}, chr(10),
    array_to_string(qs[1:3], chr(10)), CASE WHEN len(qs) > 0 THEN chr(10) ELSE '' END,
    {choose(V.CLARIFY_CLOSINGS, digest('clarify-closing', 'ctx_id'))}) AS reply
FROM q5 JOIN phrases USING (ctx_id)""", _CLARIFY)


@check("clarify_tasks", using("ctxp", TASK_SQL["clarify"][0], *_CLARIFY))
def clarify_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clarify(B.contexts(spark, sf_dir), B.SEED).drop("product_context")
