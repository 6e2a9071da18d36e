"""Gates over tables of plans and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from .geometry import clip_rect


def scene_index(scene: DataFrame, page: str = "page_id", selector: str = "selector", tier: str = "tier") -> DataFrame:
    """One row per selector of a page: how many controls carry it, and the tier of the one that does."""
    return scene.groupBy(page, selector).agg(F.count("*").alias("matches"), F.min(tier).alias("found_tier"))


def plan_tier(plans: DataFrame, scene: DataFrame, page: str = "page_id") -> DataFrame:
    """``plans(page, action, target_selector)`` plus ``matches``, ``plan_tier`` and ``tier_error`` (null if tiered)."""
    index = scene_index(scene, page).withColumnRenamed("selector", "target_selector")
    out = plans.join(index, [page, "target_selector"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    mild, aimed = F.col("action").isin("scroll", "wait", "finish"), F.col("action").isin("click", "type")
    error = (
        F.when(~F.coalesce(mild | aimed, F.lit(False)), "unrecognized-action")
        .when(aimed & (F.col("matches") == 0), "target-not-in-scene")
        .when(aimed & (F.col("matches") > 1), "target-ambiguous")
        .when(aimed & (R.tier_rank(F.col("found_tier")) == 0), "unknown-element-tier")
    )
    tier = F.when(mild, "reversible").when(F.col("action") == "click", F.col("found_tier")).when(F.col("action") == "type", R.stricter_tier(F.lit("state-changing"), F.col("found_tier")))
    return out.withColumn("tier_error", error).withColumn("plan_tier", F.when(F.col("tier_error").isNull(), tier)).drop("found_tier")


def scene_intent(scene: DataFrame, page: str = "page_id", tier: str = "tier") -> DataFrame:
    return scene.groupBy(page).agg(F.max(F.col(tier) == "destructive").alias("has_destructive"))


def intent_coherence(plans: DataFrame, scene: DataFrame, page: str = "page_id", task: str = "task") -> DataFrame:
    """Plans for a destructive task on a page without a destructive control become ``finish``; ``overridden`` says so."""
    out = plans.join(scene_intent(scene, page), page, "left")
    over = R.destructive_intent(F.col(task)) & ~F.coalesce("has_destructive", F.lit(False))
    out = out.withColumn("overridden", over)
    return out.withColumn("action", F.when(over, "finish").otherwise(F.col("action"))).withColumn("target_selector", F.when(~over, F.col("target_selector")))


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def plan_checks(plans: DataFrame, scene: DataFrame, page: str = "page_id") -> DataFrame:
    """Plans ``(page, action, target_selector, x, y, keys, task, overridden)`` with all six checks, tier and gate."""
    out = plan_tier(plans, scene, page).drop("has_destructive").join(scene_intent(scene, page), page, "left")
    action, target = F.col("action"), F.col("target_selector")
    aimed = F.coalesce(action.isin("click", "type"), F.lit(False))
    extra = F.array_sort(F.array_except("keys", F.array(*map(F.lit, P.ACTION_KEYS))))
    coherent = ~R.destructive_intent(F.col("task")) | F.coalesce("has_destructive", F.lit(False)) | F.coalesce("overridden", F.lit(False))
    tests = (
        ("action-allowed", F.coalesce(action.isin(*P.ACTIONS), F.lit(False)), F.lit("invalid action")),
        ("no-unexpected-keys", F.size(extra) == 0, F.array_join(extra, ",")),
        ("selector-in-scene", F.when(target.isNull(), ~aimed).otherwise(F.col("matches") == 1), F.concat(F.lit("matches: "), F.col("matches").cast("string"))),
        ("coordinates-finite", finite(F.col("x")) & finite(F.col("y")) & (F.col("x") >= 0) & (F.col("y") >= 0), F.lit("coordinates")),
        ("tier-computed", F.col("plan_tier").isNotNull(), F.col("tier_error")),
        ("intent-coherence", coherent, F.lit("task is destructive, the page is not")),
    )
    checks = F.array(*(F.struct(F.lit(name).alias("name"), ok.alias("pass"), F.when(~ok, why).alias("detail")) for name, ok, why in tests))
    out = out.withColumn("checks", checks).withColumn("passed", F.forall("checks", lambda c: c["pass"]))
    return out.withColumn("gate", R.gate_local(F.col("passed"), F.col("plan_tier")))


def plan_checks_wire(plans: DataFrame, scene: DataFrame, page: str = "page_id") -> DataFrame:
    """The looser variant: no selector passes, any match passes; returns ``passed`` and the first failed check."""
    present = scene.select(page, F.col("selector").alias("target_selector")).distinct().withColumn("present", F.lit(True))
    out = plans.join(present, [page, "target_selector"], "left")
    why = R.first_reason(
        (
            ("action-allowed", ~F.coalesce(F.col("action").isin(*P.ACTIONS), F.lit(False))),
            ("no-unexpected-keys", F.size(F.array_except("keys", F.array(*map(F.lit, P.ACTION_KEYS)))) > 0),
            ("selector-in-scene", F.col("target_selector").isNotNull() & F.col("present").isNull()),
            ("coordinates-finite", ~(finite(F.col("x")) & finite(F.col("y")))),
        )
    )
    return out.withColumn("failed", why).withColumn("passed", F.col("failed").isNull()).drop("present")


def validate_action(plans: DataFrame, scene: DataFrame, json: str = "plan_json", page: str = "page_id") -> DataFrame:
    """Plans as JSON, parsed and checked against their scene: a normal plan, or why it is refused."""
    shape = "action string, target_selector string, coordinates struct<x:double,y:double>, value string, reasoning_token string"
    out = plans.withColumn("p", F.from_json(json, shape)).withColumn("keys", F.json_object_keys(json))
    out = out.select("*", F.col("p.target_selector").alias("target_selector"))
    present = scene.select(page, F.col("selector").alias("target_selector")).distinct().withColumn("present", F.lit(True))
    out = out.join(present, [page, "target_selector"], "left")
    has_xy = F.col("p.coordinates").isNotNull()
    why = R.first_reason(
        (
            ("not-an-object", F.col("keys").isNull()),
            ("unexpected-keys", F.size(F.array_except("keys", F.array(*map(F.lit, P.ACTION_KEYS)))) > 0),
            ("invalid-action", ~F.coalesce(F.col("p.action").isin(*P.ACTIONS), F.lit(False))),
            ("coordinates-not-finite", has_xy & ~(finite(F.col("p.coordinates.x")) & finite(F.col("p.coordinates.y")))),
            ("target-not-in-scene", F.col("target_selector").isNotNull() & F.col("present").isNull()),
        )
    )
    plan = F.struct(
        F.col("p.action").alias("action"), "target_selector", F.coalesce("p.coordinates.x", F.lit(0.0)).alias("x"), F.coalesce("p.coordinates.y", F.lit(0.0)).alias("y"), F.col("p.value").alias("value"), F.coalesce("p.reasoning_token", F.lit("")).alias("reasoning_token")
    )
    return out.withColumn("refused", why).withColumn("plan", F.when(why.isNull(), plan)).drop("p", "keys", "present", "target_selector")


def action_options(controls: DataFrame, tasks: DataFrame, page: str = "page_id", task: str = "task") -> DataFrame:
    """Every action a scene allows, once each and in order: clicks, each token typed in each field, finish, escape."""
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(task, F.lit(P.VAULT_TOKEN), F.lit(0))))
    scoped = tasks.select(page, tokens.alias("tokens"))
    rows = controls.join(scoped, page)
    clickable = F.col("type").isin("button", "link", "checkbox", "radio", "submit")
    acts = F.when(clickable, F.array(F.struct(F.lit(0).alias("i"), F.concat(F.lit("click "), "selector").alias("action")))).otherwise(
        F.transform("tokens", lambda t, i: F.struct(i.alias("i"), F.concat(F.lit("type "), "selector", F.lit(" "), t).alias("action")))
    )
    listed = rows.select(page, F.col("ord").cast("long").alias("ord"), F.inline(acts))
    last = (1 << 31) - 2
    ends = scoped.select(page, F.explode(F.array(F.struct(F.lit(last).cast("long").alias("ord"), F.lit("finish").alias("action")), F.struct(F.lit(last + 1).cast("long").alias("ord"), F.lit("none_of_these").alias("action")))).alias("e")).select(page, "e.ord", F.lit(0).alias("i"), "e.action")
    first = listed.unionByName(ends).groupBy(page, "action").agg(F.min(F.struct("ord", "i")).alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(page).orderBy("at"))).select(page, "n", "action")


def fastpath_decide(predictions: DataFrame, options: DataFrame, least: float = 0.9, page: str = "page_id") -> DataFrame:
    """Whether a model's choice is used, or the first reason that it isn't."""
    offered = options.select(page, F.col("action").alias("choice")).withColumn("offered", F.lit(True))
    out = predictions.join(offered, [page, "choice"], "left")
    why = R.first_reason(
        (
            ("outside-options", F.col("offered").isNull()),
            ("none-of-these", F.col("choice") == "none_of_these"),
            ("needs-free-text", F.col("free_p") >= 0.5),
            ("confidence-too-low", ~(F.coalesce("confidence", F.lit(-1.0)) >= least)),
        )
    )
    return out.withColumn("reason", F.coalesce(why, F.lit("accepted"))).withColumn("used", F.col("reason") == "accepted").drop("offered")


UUID = "(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}|0{8}-0{4}-0{4}-0{4}-0{12}|f{8}-f{4}-f{4}-f{4}-f{12})$"


def validate_scene(scenes: DataFrame, scheme: str = "scene/1") -> DataFrame:
    """``scenes`` plus ``reason``: the first contract a scene breaks, null for a sound one.

    Fields come first, then what only a scene of sound fields can break: ids that repeat, boxes outside the viewport.
    """
    side = float(P.SCENE_SIDE)
    whole = lambda v: F.coalesce((v == F.floor(v)) & (v >= 1) & (v <= side), F.lit(False))
    sound = lambda r: finite(r["x"]) & finite(r["y"]) & r["x"].between(0, side) & r["y"].between(0, side) & F.coalesce((r["width"] > 0) & (r["width"] <= side) & (r["height"] > 0) & (r["height"] <= side), F.lit(False))
    outside = lambda x: (x["rect"]["x"] + x["rect"]["width"] > F.col("viewport.width") + 0.01) | (x["rect"]["y"] + x["rect"]["height"] > F.col("viewport.height") + 0.01)
    lacks = lambda test: F.coalesce(~test, F.lit(True))
    ids = F.transform("controls", lambda c: c["id"])
    why = R.first_reason(
        (
            ("scheme", ~F.col("scheme").eqNullSafe(scheme)),
            ("revision", lacks(F.col("revision").rlike(UUID))),
            ("viewport", ~(whole(F.col("viewport.width")) & whole(F.col("viewport.height")))),
            ("too-many", (F.size("controls") > P.SCENE_CONTROLS) | (F.size("regions") > P.SCENE_REGIONS)),
            ("control-id", F.exists("controls", lambda c: lacks(c["id"].rlike(P.CONTROL_ID)))),
            ("role", F.exists("controls", lambda c: lacks(c["role"].isin(*P.SCENE_ROLES)))),
            ("label", F.exists("controls", lambda c: lacks(c["label"].isin(*P.SAFE_LABELS)))),
            ("region-kind", F.exists("regions", lambda r: lacks(r["kind"].isin(*P.REGION_KINDS)))),
            ("rect", F.exists("controls", lambda c: lacks(sound(c["rect"]))) | F.exists("regions", lambda r: lacks(sound(r["rect"])))),
            ("duplicate-id", F.size(F.array_distinct(ids)) < F.size(ids)),
            ("outside-viewport", F.exists("controls", outside) | F.exists("regions", outside)),
        )
    )
    return scenes.withColumn("reason", why)


def make_scene(controls: DataFrame, regions: DataFrame, page: str = "page_id", width: float = 1280.0, height: float = 800.0) -> DataFrame:
    """``(page, controls, regions)`` rebuilt from ``controls(page, ord, id, role, label, x, y, w, h)`` and
    ``regions(page, kind, x, y, w, h)``: labels off the safe list go, boxes are clipped, regions padded by two.

    A page is a row by contract: what :func:`validate_scene` lets through is bounded.
    """
    size = F.lit(width), F.lit(height)
    box = lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("width"), r["h"].alias("height")).alias("rect")
    safe = controls.where(F.col("label").isin(*P.SAFE_LABELS)).withColumn("r", clip_rect(*size)).where("r IS NOT NULL")
    kept = safe.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "role", "label", box(F.col("r"))))).alias("controls"))
    padded = regions.withColumn("r", clip_rect(*size, pad=2.0)).where("r IS NOT NULL")
    hidden = padded.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("kind", box(F.col("r"))))).alias("regions"))
    pages = controls.select(page).union(regions.select(page)).distinct()
    none = lambda c, df: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    return pages.join(kept, page, "left").join(hidden, page, "left").select(page, none("controls", kept), none("regions", hidden))


def risk_score(regions: DataFrame, controls: DataFrame, key: str = "doc_id") -> DataFrame:
    """Points and band of each scene from its regions' kinds and number of controls; scenes without regions count too.

    ``regions(key, kind)``, ``controls(key, n_controls)`` with a row for each scene.
    """
    kinds = regions.groupBy(key, "kind").count()
    hist = kinds.groupBy(key).agg(F.sum(F.when(F.col("kind").isin(*P.HIGH_KINDS), F.col("count")).otherwise(0)).alias("high"), F.sum("count").alias("regions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("kinds"))
    out = controls.join(hist, key, "left").na.fill(0, ["high", "regions"])
    points = F.col("high") * 3 + (F.col("regions") - F.col("high")) + F.when(F.col("n_controls") == 0, 2).otherwise(0) + F.when(F.col("high") >= 2, 2).otherwise(0)
    return out.withColumn("points", points).withColumn("band", F.when(F.col("points") >= 8, "high").when(F.col("points") >= 3, "elevated").otherwise("low"))


def rule_parity(controls: DataFrame, one: Column, other: Column) -> DataFrame:
    """Rows on which two sets of rules disagree."""
    return controls.withColumn("one", one).withColumn("other", other).where(~F.col("one").eqNullSafe(F.col("other")))


def gate_counts(plans: DataFrame, *by: str) -> DataFrame:
    return plans.groupBy(*by, "gate").count()


