"""Task generators: one task per context, its answer decided by constraints.

Each generator takes contexts (ctx_id, products) and works inside the row: the tightening
and relaxing of constraints is a fold over a fixed count of steps, a step that finds
nothing to do leaves the constraint as it is. So generation adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from aislekit import vocabulary as V
from aislekit.functions.constraints import constraint, satisfying
from aislekit.functions.draws import choose, digest, index, let, pick, shuffled, uniform, unit
from aislekit.functions.products import fixed, item_phrase, product_line
from aislekit.functions.templates import fill, fill_one, which
from aislekit.functions.text import strip
from aislekit.operators import contexts as C


def _texts() -> Column:
    return F.array().cast("array<string>")


def _unknown() -> Column:
    return F.lit(None).cast("double")


def _maybe(value: Column) -> Column:
    """The value in a nullable column, as a fold that later sets it to null must start with."""
    return F.when(F.size("products") >= 0, value)


def _start(max_price: Column, brand: Column, features: Column, min_rating: Column) -> Column:
    return constraint(_maybe(max_price), _maybe(brand), _maybe(features), _maybe(min_rating))


def _settle(start: Column, steps: int, settled: Callable, change: Callable) -> Column:
    """Change a constraint step by step until `settled` says yes, `steps` times at most.

    Gives (cons, done). A settled constraint is passed through without another test, so a
    row costs as many tests as it needs. `change` gets the constraint, the products that
    meet it and the number of the step.
    """
    def step(state: Column, i: Column) -> Column:
        def judge(found: Column) -> Column:
            done = F.coalesce(settled(found), F.lit(False))
            cons = F.when(done, state["cons"]).otherwise(change(state["cons"], found, i))
            return F.struct(cons.alias("cons"), done.alias("done"))

        return F.when(state["done"], state).otherwise(let(satisfying(F.col("products"), state["cons"]), judge))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(start.alias("cons"), F.lit(False).alias("done")), step
    )


def _or_else(folded: str, settled: Callable, fallback: Column) -> Column:
    """The settled constraint, else the fallback; only unsettled rows are tested once more."""
    state = F.col(folded)
    good = state["done"] | settled(satisfying(F.col("products"), state["cons"]))
    return F.when(good, state["cons"]).otherwise(fallback)


def _with(cons: Column, **changes: Column) -> Column:
    parts = {name: changes.get(name, cons[name]) for name in ("max_price", "brand", "features", "min_rating")}
    return constraint(**parts)


def _named(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def _dollars(price: Column) -> Column:
    return F.floor(price).cast("string")


def _without(values: Column, gone: Column) -> Column:
    return F.filter(values, lambda v: ~F.array_contains(gone, v))


def _join_last(values: Column, sep: str, last_sep: str) -> Column:
    """All values joined, the last one by its own separator."""
    n = F.size(values)
    head = F.array_join(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), sep)
    return F.when(n <= 1, F.coalesce(F.get(values, F.lit(0)), F.lit(""))).otherwise(
        F.concat(head, F.lit(last_sep), F.get(values, n - 1))
    )


# ---- pick one ------------------------------------------------------------------------


def pick_one_constraints(ctx: DataFrame, seed: int) -> DataFrame:
    """The contexts with a target and the constraint that singles it out where possible.

    Adds `target`, `constraint` and `satisfying_ids`.
    """
    key = F.col("ctx_id")
    products, target, price = F.col("products"), F.col("target"), F.col("target.price")
    feats, rare, common = F.col("feats"), F.col("rare"), F.col("common")

    ctx = C.rare_common(C.draw_target(ctx.where(F.size("products") > 0), seed))
    ctx = ctx.withColumn("feats", F.coalesce(F.col("target.features"), _texts()))

    first = F.coalesce(
        pick(rare, digest(seed, "one-feature", key, F.lit(0))),
        pick(common, digest(seed, "one-feature", key, F.lit(0))),
    )
    start = _start(
        price + uniform(digest(seed, "one-price", key), 5, 25),
        F.lit(None),
        F.when(first.isNull(), _texts()).otherwise(F.array(first)),
        _unknown(),
    )

    def tighten(cons: Column, found: Column, step: Column) -> Column:
        others = F.filter(found, lambda p: p["product_id"] != target["product_id"])
        free_rare = _without(rare, cons["features"])
        pool = F.when(F.size(free_rare) > 0, free_rare).otherwise(_without(common, cons["features"]))
        ceiling = F.least(F.array_min(C.prices(others)) - 0.01, price + 0.001)
        floor = F.least(target["avg_rating"], F.array_max(C.ratings(others)) + 0.001)

        def change(d: Column) -> Column:
            return (
                F.when(
                    d["feature"].isNotNull(),
                    _with(cons, features=F.concat(cons["features"], F.array(d["feature"]))),
                )
                .when(~_named(cons["brand"]) & _named(target["brand"]), _with(cons, brand=target["brand"]))
                .when(F.coalesce(d["ceiling"] >= price, F.lit(False)), _with(cons, max_price=d["ceiling"]))
                .when(d["floor"].isNotNull(), _with(cons, min_rating=d["floor"]))
                .otherwise(_with(
                    cons,
                    brand=F.when(_named(target["brand"]), target["brand"]).otherwise(cons["brand"]),
                    features=F.when(F.size(cons["features"]) < F.size(feats), F.array_distinct(feats))
                    .otherwise(cons["features"]),
                ))
            )

        # least() skips nulls, so both sides must be there for a bound to count.
        bounds = F.struct(
            pick(pool, digest(seed, "one-feature", key, step)).alias("feature"),
            F.when(price.isNotNull() & (F.size(C.prices(others)) > 0), ceiling).alias("ceiling"),
            F.when(target["avg_rating"].isNotNull() & (F.size(C.ratings(others)) > 0), floor).alias("floor"),
        )
        return let(bounds, change)

    def relax(cons: Column) -> Column:
        return (
            F.when(cons["min_rating"].isNotNull(), _with(cons, min_rating=_unknown()))
            .otherwise(_with(cons, max_price=cons["max_price"] + 10.0))
        )

    def single(found: Column) -> Column:
        return (F.size(found) == 1) & (F.get(found, F.lit(0))["product_id"] == target["product_id"])

    def change(cons: Column, found: Column, i: Column) -> Column:
        return F.when(F.size(found) > 1, tighten(cons, found, i)).otherwise(relax(cons))

    ctx = ctx.withColumn("folded", _settle(start, 6, single, change))
    strict = _with(
        F.col("folded.cons"), brand=target["brand"], features=F.array_distinct(feats),
        max_price=F.coalesce(price + 0.001, F.col("folded.cons.max_price")),
    )
    ctx = ctx.withColumn("constraint", _or_else("folded", single, strict))
    return C.satisfying_ids(ctx).drop("feats", "rare", "common", "folded")


def pick_one_query(target: Column, cons: Column) -> Column:
    """The request text; its price is rounded down, so it may lie below the target's."""
    return F.concat(
        F.lit("Need a "), F.replace(target["category"], F.lit("_"), F.lit(" ")),
        F.coalesce(F.concat(F.lit(" under $"), _dollars(cons["max_price"])), F.lit("")),
        F.when(_named(cons["brand"]), F.concat(F.lit(" from "), cons["brand"])).otherwise(""),
        F.when(
            F.size(cons["features"]) > 0,
            F.concat(F.lit(" with "), F.array_join(F.array_sort(cons["features"]), ", ")),
        ).otherwise(""),
        F.coalesce(F.concat(F.lit(" with rating at least "), fixed(cons["min_rating"], 1)), F.lit("")),
        F.lit("."),
    )


def pick_one(ctx: DataFrame, seed: int) -> DataFrame:
    """(ctx_id, task, query, product_context, satisfying_ids)."""
    decided = pick_one_constraints(ctx, seed)
    return decided.select(
        "ctx_id", F.lit("pick_one").alias("task"),
        pick_one_query(F.col("target"), F.col("constraint")).alias("query"),
        F.col("products").alias("product_context"), "satisfying_ids",
    )


# ---- pick list -----------------------------------------------------------------------


def pick_list_constraints(ctx: DataFrame, seed: int) -> DataFrame:
    """The contexts with a constraint that at least two products meet where possible."""
    key, products = F.col("ctx_id"), F.col("products")
    ctx = ctx.where(F.size("products") > 0)

    often = shuffled(C.repeated(C.features_in(products)), seed, "list-feature", key)
    n_features = 1 + index(digest(seed, "list-feature-count", key), F.lit(2))
    target_price = F.coalesce(C.point_between(C.prices(products), 0.7), F.lit(200.0))
    ceiling = target_price + uniform(digest(seed, "list-price", key), 20, 100)
    brand = F.when(
        unit(digest(seed, "list-brand", key)) < 0.3,
        pick(C.repeated(C.brands(products)), digest(seed, "list-which-brand", key)),
    )
    rating = F.when(
        unit(digest(seed, "list-rating", key)) < 0.4, C.point_between(C.ratings(products), 0.3)
    )
    ctx = ctx.withColumn("ceiling", ceiling)
    start = _start(F.col("ceiling"), brand, F.slice(often, 1, n_features), rating)

    def enough(found: Column) -> Column:
        return F.size(found) >= 2

    def relax(cons: Column, found: Column, i: Column) -> Column:
        kept = pick(cons["features"], digest(seed, "list-keep", key, i))
        return (
            F.when(cons["min_rating"].isNotNull(), _with(cons, min_rating=_unknown()))
            .when(cons["brand"].isNotNull(), _with(cons, brand=F.lit(None)))
            .when(F.size(cons["features"]) > 1, _with(cons, features=F.array(kept)))
            .when(F.size(cons["features"]) == 1, _with(cons, features=_texts()))
            .otherwise(_with(cons, max_price=cons["max_price"] + 100.0))
        )

    last = constraint(F.col("ceiling") + 200.0, F.lit(None), _texts(), F.lit(None))
    ctx = ctx.withColumn("folded", _settle(start, 10, enough, relax))
    ctx = ctx.withColumn("constraint", _or_else("folded", enough, last))
    return C.satisfying_ids(ctx).drop("ceiling", "folded")


def _wishes(cons: Column, seed: int, key: Column) -> Column:
    """The wishes in random order, with a blank before them; empty for none."""
    wishes = F.filter(F.array(
        F.concat(F.lit("under $"), _dollars(cons["max_price"])),
        F.when(_named(cons["brand"]), F.concat(F.lit("from "), cons["brand"])),
        F.when(
            F.size(cons["features"]) > 0,
            F.concat(F.lit("with "), F.array_join(F.array_sort(cons["features"]), ", ")),
        ),
        F.concat(F.lit("rating at least "), fixed(cons["min_rating"], 1)),
    ), lambda w: w.isNotNull())
    return let(
        shuffled(wishes, seed, "list-wishes", key),
        lambda ws: F.when(F.size(ws) > 0, F.concat(F.lit(" "), _join_last(ws, ", ", " and "))).otherwise(""),
    )


def pick_list_query(style: Column, phrase: Column, wishes: Column) -> Column:
    """The request text."""
    text = strip(fill_one(V.PICK_LIST_STYLES, style, {"item": phrase, "rest": wishes}))
    return let(text, lambda t: F.when(t.endswith("?") | t.endswith("."), t).otherwise(F.concat(t, F.lit("."))))


def _recommendations(chosen: Column) -> Column:
    """The sentences on the products, cheapest first; an unknown price counts as 0."""
    by_price = F.array_sort(F.transform(chosen, lambda p, i: F.struct(
        F.coalesce(p["price"], F.lit(0.0)).alias("price"), i.alias("i"), p.alias("product")
    )))
    lines = F.transform(by_price, lambda e: product_line(e["product"], "list"))
    return let(lines, lambda ls: _join_last(ls, ", ", ", and "))


def pick_list_reply(style: Column, count: Column, recommendations: Column) -> Column:
    """The reply text."""
    values = {"count": count.cast("string"), "product_recommendations": recommendations}
    return fill_one(V.PICK_LIST_REPLIES, style, values)


def pick_list(ctx: DataFrame, seed: int) -> DataFrame:
    """(ctx_id, task, query, product_context, predicted_ids, reply)."""
    key, products = F.col("ctx_id"), F.col("products")
    decided = pick_list_constraints(ctx, seed).withColumns({
        "style": which(V.PICK_LIST_STYLES, digest(seed, "list-style", key)),
        "reply_style": which(V.PICK_LIST_REPLIES, digest(seed, "list-reply", key)),
        "phrase": item_phrase(products, digest(seed, "list-item", key), "product"),
        "wishes": _wishes(F.col("constraint"), seed, key),
        "chosen": F.filter(products, lambda p: F.array_contains(F.col("satisfying_ids"), p["product_id"])),
    }).withColumn("recommended", _recommendations(F.col("chosen")))
    return decided.select(
        "ctx_id", F.lit("pick_list").alias("task"),
        pick_list_query(F.col("style"), F.col("phrase"), F.col("wishes")).alias("query"),
        products.alias("product_context"), F.col("satisfying_ids").alias("predicted_ids"),
        pick_list_reply(F.col("reply_style"), F.size("chosen"), F.col("recommended")).alias("reply"),
    )


# ---- reject --------------------------------------------------------------------------


def _pick_absent_pair(absent: Column, drawn: Column) -> Column:
    """One random pair out of (f1, partners), without listing the pairs; null if there is none."""
    total = F.aggregate(absent, F.lit(0), lambda n, e: n + F.size(e["partners"]))
    none = F.struct(
        index(drawn, total).alias("left"), F.lit(None).cast("array<string>").alias("pair")
    )

    def walk(state: Column, e: Column) -> Column:
        n = F.size(e["partners"])
        here = F.array(e["f1"], F.get(e["partners"], state["left"]))
        return (
            F.when(state["pair"].isNotNull(), state)
            .when(state["left"] < n, F.struct(state["left"].alias("left"), here.alias("pair")))
            .otherwise(F.struct((state["left"] - n).alias("left"), state["pair"].alias("pair")))
        )

    return F.aggregate(absent, none, walk)["pair"]


def reject_constraints(ctx: DataFrame, seed: int) -> DataFrame:
    """The contexts with a constraint that no product meets, unless unknown values pass."""
    key, products = F.col("ctx_id"), F.col("products")
    ctx = ctx.where(F.size("products") > 0).withColumns({
        "min_price": F.coalesce(F.array_min(C.prices(products)), F.lit(0.0)),
        "max_rating": F.coalesce(F.array_max(C.ratings(products)), F.lit(5.0)),
        "all_features": F.array_distinct(C.features_in(products)),
        "absent": C.absent_partners(products),
    })
    ctx = ctx.withColumn("pair", _pick_absent_pair(F.col("absent"), digest(seed, "reject-pair", key)))
    min_price, max_rating = F.col("min_price"), F.col("max_rating")

    def below(salt: str, low: float, high: float, *more: Column) -> Column:
        return F.greatest(F.lit(0.0), min_price - uniform(digest(seed, salt, key, *more), low, high))

    def above(salt: str, *more: Column) -> Column:
        return max_rating + uniform(digest(seed, salt, key, *more), 0.1, 0.5)

    start = _start(
        F.when(F.col("pair").isNull(), below("reject-price", 5, 30)),
        F.lit(None),
        F.coalesce(F.col("pair"), _texts()),
        F.when(unit(digest(seed, "reject-rated", key)) < 0.5, above("reject-rating")),
    )
    foreign = let(C.brands(products), lambda own: let(
        _without(F.array(*[F.lit(b) for b in V.FOREIGN_BRANDS]), own),
        lambda free: F.when(F.size(free) > 0, free).otherwise(F.array(*[F.lit(b) for b in V.FOREIGN_BRANDS])),
    ))

    def nothing(found: Column) -> Column:
        return F.size(found) == 0

    def tighten(cons: Column, found: Column, i: Column) -> Column:
        more = pick(_without(F.col("all_features"), cons["features"]), digest(seed, "reject-feature", key, i))
        return (
            F.when(cons["max_price"].isNull(), _with(cons, max_price=below("reject-lower", 1, 20, i)))
            .when(
                cons["min_rating"].isNull() & (F.size(C.ratings(products)) > 0),
                _with(cons, min_rating=above("reject-higher", i)),
            )
            .otherwise(let(more, lambda f: F.when(
                f.isNotNull(), _with(cons, features=F.concat(cons["features"], F.array(f)))
            ).otherwise(_with(cons, brand=pick(foreign, digest(seed, "reject-brand", key, i))))))
        )

    ctx = ctx.withColumn("folded", _settle(start, 6, nothing, tighten))
    forced = _with(
        F.col("folded.cons"), max_price=F.greatest(F.lit(0.0), min_price - 0.01), min_rating=max_rating + 0.1
    )
    ctx = ctx.withColumn("tight", _or_else("folded", nothing, forced))
    # A request always names a price.
    priced = _with(F.col("tight"), max_price=F.coalesce(F.col("tight.max_price"), F.floor(min_price).cast("double")))
    return ctx.withColumn("constraint", priced).drop(
        "min_price", "max_rating", "all_features", "absent", "pair", "folded", "tight"
    )


def _reject_clauses(cons: Column) -> dict[str, Column]:
    """The parts of a request text; a rating above 5.0 is not told."""
    feats = F.array_sort(cons["features"])
    return {
        "price": _dollars(F.coalesce(cons["max_price"], F.lit(0.0))),
        "feat_clause": F.when(F.size(feats) > 0, F.concat(F.lit(" with "), _join_last(feats, ", ", " and "))).otherwise(""),
        "brand_clause": F.when(_named(cons["brand"]), F.concat(F.lit(" from "), cons["brand"])).otherwise(""),
        "rating_clause": F.when(
            cons["min_rating"] <= 5.0, F.concat(F.lit(" with rating at least "), fixed(cons["min_rating"], 1))
        ).otherwise(""),
    }


def reject_query(style: Column, values: dict[str, Column]) -> Column:
    """The request text."""
    return F.concat(strip(fill_one(V.REJECT_STYLES, style, values)), F.lit("."))


def reject_reply(alternatives: Column, seed: int, key: Column) -> Column:
    lines = F.transform(alternatives, lambda p: product_line(p, "reject"))
    return F.array_join(F.concat(
        F.array(
            choose(V.REJECT_OPENERS, digest(seed, "reject-opener", key)),
            choose(V.REJECT_SEGUES, digest(seed, "reject-segue", key)),
        ),
        lines,
    ), "\n")


def reject(ctx: DataFrame, seed: int) -> DataFrame:
    """(ctx_id, task, query, product_context, predicted_ids, reply)."""
    key, products, cons = F.col("ctx_id"), F.col("products"), F.col("constraint")
    clauses = _reject_clauses(cons)
    decided = reject_constraints(ctx, seed).withColumns({
        "style": which(V.REJECT_STYLES, digest(seed, "reject-style", key)),
        "item": item_phrase(products, digest(seed, "reject-item", key), "blender"),
        "nearest": C.closest(products, cons["features"], F.get(products, F.lit(0))["category"], cons["max_price"]),
        **clauses,
    })
    return decided.select(
        "ctx_id", F.lit("reject").alias("task"),
        reject_query(F.col("style"), {name: F.col(name) for name in ("item", *clauses)}).alias("query"),
        products.alias("product_context"), _texts().alias("predicted_ids"),
        reject_reply(F.col("nearest"), seed, key).alias("reply"),
    )


# ---- clarify -------------------------------------------------------------------------


def clarify_slots(ctx: DataFrame, seed: int) -> DataFrame:
    """The contexts with their ranges and what is left open: budget, feature, brand.

    Adds low, high, rating_low, rating_high, n_brands, ask_budget, feature, ask_brand.
    """
    key, products = F.col("ctx_id"), F.col("products")
    zero = F.lit(0.0)
    ctx = ctx.where(F.size("products") > 0).withColumns({
        "low": F.coalesce(F.array_min(C.prices(products)), zero),
        "high": F.coalesce(F.array_max(C.prices(products)), zero),
        "rating_low": F.coalesce(F.array_min(C.ratings(products)), zero),
        "rating_high": F.coalesce(F.array_max(C.ratings(products)), zero),
        "n_brands": F.size(F.array_distinct(C.brands(products))),
        "freq": C.frequency(products),
    }).withColumn("common", C.top(F.col("freq"), 2))
    slots = F.filter(F.array(
        F.when(F.col("high") - F.col("low") >= 80.0, F.lit("budget")),
        F.when(F.col("common") != "", F.lit("feature")),
        F.when(F.col("n_brands") >= 2, F.lit("brand")),
    ), lambda s: s.isNotNull())
    ctx = ctx.withColumn("slots", shuffled(slots, seed, "clarify-slots", key))
    n_chosen = 1 + index(digest(seed, "clarify-count", key), F.least(F.greatest(F.size("slots"), F.lit(1)), F.lit(2)))
    ctx = ctx.withColumn("chosen", F.slice("slots", 1, n_chosen))
    nothing = F.size("chosen") == 0
    any_feature = F.coalesce(F.get(F.col("freq"), F.lit(0))["feature"], F.lit(""))
    return ctx.withColumns({
        "ask_budget": nothing | F.array_contains("chosen", "budget"),
        "feature": F.when(nothing, any_feature)
        .when(F.array_contains("chosen", "feature"), F.col("common")).otherwise(""),
        "ask_brand": F.array_contains("chosen", "brand"),
    }).drop("freq", "common", "slots", "chosen")


def _clarify_hints(feature: Column, ask_brand: Column) -> dict[str, Column]:
    return {
        "feat_hint": F.when(
            feature != "", F.concat(F.lit(" with "), feature, F.lit(" (if that's worth it)"))
        ).otherwise(""),
        "brand_hint": F.when(ask_brand, F.lit(" Any brand is fine, I think.")).otherwise(""),
    }


def clarify_query(style: Column, values: dict[str, Column]) -> Column:
    """The request text."""
    return strip(fill_one(V.CLARIFY_STYLES, style, values))


def clarify_questions(products: Column, seed: int, key: Column) -> Column:
    """Two or three questions, in the order of their rules; fewer if the context allows no more."""
    span = F.col("high") - F.col("low")
    rating_span = F.col("rating_high") - F.col("rating_low")
    middle = F.when(
        F.col("high") != 0, F.floor((F.col("low") + F.col("high")) / 2).cast("string")
    ).otherwise("100")
    budget = fill(V.BUDGET_QUESTION, {"mid": middle})
    two_brands = F.col("n_brands") >= 2

    def listed(*questions: Column) -> Column:
        return F.filter(F.array(*questions), lambda q: q.isNotNull())

    asked = listed(
        F.when(F.col("ask_budget") & (span >= 20.0), budget),
        F.when(F.col("feature") != "", fill(V.FEATURE_QUESTION, {"feature": F.col("feature")})),
        F.when(F.col("ask_brand") & two_brands, F.lit(V.BRAND_QUESTION)),
    )
    lower = F.transform(C.features_in(products), F.lower)

    def about(words: list[str]) -> Column:
        return F.exists(lower, lambda f: reduce(lambda a, b: a | b, [f.contains(w) for w in dict.fromkeys(words)]))

    topics = shuffled(
        listed(*[F.when(about(words), F.lit(question)) for words, question in V.TOPIC_QUESTIONS]),
        seed, "clarify-topics", key,
    )

    def up_to(limit: int, questions: Column, condition: Column, question: Column) -> Column:
        return F.when((F.size(questions) < limit) & condition, F.concat(questions, F.array(question))).otherwise(questions)

    def lacks(questions: Column, part: str) -> Column:
        return ~F.exists(questions, lambda q: q.contains(part))

    trade_off = F.lit(V.TRADE_OFF_QUESTION)
    rules = [
        lambda qs: F.concat(qs, F.slice(topics, 1, F.greatest(F.lit(3) - F.size(qs), F.lit(0)))),
        lambda qs: up_to(3, qs, (span >= 20.0) | (rating_span >= 0.4), trade_off),
        lambda qs: up_to(3, qs, ~(F.col("ask_brand") & two_brands) & two_brands, F.lit(V.BRAND_OPEN_QUESTION)),
        lambda qs: up_to(2, qs, (span >= 20.0) & lacks(qs, "budget cap"), budget),
        lambda qs: up_to(2, qs, (rating_span >= 0.4) & lacks(qs, "prioritizing"), trade_off),
    ]
    questions = asked
    for rule in rules:
        questions = let(questions, rule)
    return F.slice(questions, 1, 3)


def clarify_reply(questions: Column, seed: int, key: Column) -> Column:
    return F.array_join(F.concat(
        F.array(choose(V.CLARIFY_OPENINGS, digest(seed, "clarify-opening", key))),
        questions,
        F.array(choose(V.CLARIFY_CLOSINGS, digest(seed, "clarify-closing", key))),
    ), "\n")


def clarify(ctx: DataFrame, seed: int) -> DataFrame:
    """(ctx_id, task, query, product_context, reply)."""
    key, products = F.col("ctx_id"), F.col("products")
    hints = _clarify_hints(F.col("feature"), F.col("ask_brand"))
    slotted = clarify_slots(ctx, seed).withColumns({
        "style": which(V.CLARIFY_STYLES, digest(seed, "clarify-style", key)),
        "item": item_phrase(products, digest(seed, "clarify-item", key), "blender"),
        **hints,
    })
    return slotted.select(
        "ctx_id", F.lit("clarify").alias("task"),
        clarify_query(F.col("style"), {name: F.col(name) for name in ("item", *hints)}).alias("query"),
        products.alias("product_context"),
        clarify_reply(clarify_questions(products, seed, key), seed, key).alias("reply"),
    )
