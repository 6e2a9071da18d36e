"""Queries of rules and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..functions import spans as S
from ..operators import detection as D
from ..operators import gates as G
from ..sources import tables as A
from .detection import CONTROLS
from .inputs import PREDICTIONS, predictions, probed, table
from .registry import query

#: Labels that the pages' own lack, dealt to every second control; the last four have one look and other code points.
LABELS = (
    "Delete this draft", "Save my draft", "Open drawer", "Back to list", "Avatar", "मसौदा मिटाएँ", "Kick out the bot", "Leave the household", "View ledger", "Search",
    "परिवार छो\u0921\u093cें", "परिवार छो\u095cें", "De\u200blete row", "A\u0301rea",
)
_PICK = "([" + ", ".join(f"'{x}'" for x in LABELS) + "])[(page_id * 3 + ord) % 14 + 1]"
RICH = f"""{CONTROLS}, rich AS (SELECT page_id, ord, tag, type, href, CASE WHEN ord % 10 = 9 THEN '#c0' ELSE selector END AS selector, CASE WHEN ord % 2 = 0 THEN {_PICK} ELSE label END AS label,
 CASE WHEN ord % 7 = 3 THEN 'Next' WHEN ord % 7 = 5 THEN '' WHEN ord % 14 = 8 THEN '\u00c1rea' END AS aria, ord % 11 = 4 AS submits FROM controls)"""


def rich_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.parse_controls(table(spark, sf_dir, "pages"))
    pick = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("page_id") * 3 + F.col("ord")) % 14 + 1).cast("int"))
    return c.select(
        "page_id", "ord", "tag", "type", "href", F.when(F.col("ord") % 10 == 9, "#c0").otherwise(F.col("selector")).alias("selector"), F.when(F.col("ord") % 2 == 0, pick).otherwise(F.col("label")).alias("label"),
        F.when(F.col("ord") % 7 == 3, "Next").when(F.col("ord") % 7 == 5, "").when(F.col("ord") % 14 == 8, "\u00c1rea").alias("aria"), (F.col("ord") % 11 == 4).alias("submits"),
    )


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"visible": F.col("label"), "aria": F.col("aria"), "href": F.col("href"), "type": F.col("type"), "submits": F.col("submits")}
    return rich_controls(spark, sf_dir).withColumn("t", R.click_tier(fields)).select("*", "t.tier", "t.basis").drop("t")


def quoted(regex: str) -> str:
    """ASCII ``\\b`` is RE2's own."""
    return f"$re${regex}$re$"


SHOWN = lambda x: f"regexp_replace(nfc_normalize(coalesce({x}, '')), '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
_SLUG = lambda x: f"trim(regexp_replace({SHOWN(x)}, '[\\s\\-_/.?=&+#:%]+', ' ', 'g'))"
_COLL = lambda x: f"lower(trim(regexp_replace({SHOWN(x)}, '\\s+', ' ', 'g')))"
_ANY = lambda names, regex: "(" + " OR ".join(f"regexp_matches({_SLUG(n)}, {quoted(regex)})" for n in names) + ")"
_NAME = "coalesce(nullif(aria, ''), nullif(label, ''), '')"
TIERED = f"""{RICH}, b AS (SELECT *, CASE WHEN {_ANY(('label', 'aria', 'href', 'type'), P.DESTRUCTIVE_LABEL)} THEN 'destructive-keyword' WHEN {_ANY(('label', 'aria', 'type'), P.SUBMIT_LABEL)} THEN 'submit-keyword'
 WHEN submits THEN 'submits-form' WHEN {_COLL('label')} <> '' AND {_COLL('aria')} <> '' AND NOT contains({_COLL('label')}, {_COLL('aria')}) AND NOT contains({_COLL('aria')}, {_COLL('label')}) THEN 'name-mismatch'
 WHEN regexp_matches({_COLL(_NAME)}, {quoted(P.NAVIGATION_LABEL)}) THEN 'navigation-label' ELSE 'unproven' END AS basis FROM rich),
tiered AS (SELECT *, CASE basis WHEN 'destructive-keyword' THEN 'destructive' WHEN 'navigation-label' THEN 'navigational' ELSE 'state-changing' END AS tier FROM b)"""


@query(f"""SELECT conv_id, turn, regexp_matches({SHOWN('t')}, {quoted(P.DESTRUCTIVE_INTENT)}) AS intent FROM
(SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' please delete it' WHEN 1 THEN ' undeleted' WHEN 2 THEN ' परिवार छो\u095cें' WHEN 3 THEN ' de\u200dlete' ELSE ' leave the team' END AS t FROM conversations WHERE role = 'user')""")
def d1_destructive_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 5
    task = F.concat("text", F.when(k == 0, " please delete it").when(k == 1, " undeleted").when(k == 2, " परिवार छो\u095cें").when(k == 3, " de\u200dlete").otherwise(" leave the team"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", R.destructive_intent(task).alias("intent"))


@query(f"WITH {TIERED} SELECT page_id, ord, tier, basis FROM tiered")
def d2_click_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(spark, sf_dir).select("page_id", "ord", "tier", "basis")


_BOTH = SHOWN("label || ' ' || type")
WIRE = f"""CASE WHEN regexp_matches({_BOTH}, {quoted(P.DESTRUCTIVE_LABEL)}) THEN 'destructive' WHEN regexp_matches({_BOTH}, {quoted(P.SUBMIT_LABEL)}) THEN 'state-changing'
 WHEN regexp_matches(trim({SHOWN('label')}), {quoted(P.NAVIGATION_LABEL)}) THEN 'navigational' ELSE 'state-changing' END"""


@query(f"WITH {RICH} SELECT page_id, ord, {WIRE} AS tier FROM rich")
def d3_click_tier_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich_controls(spark, sf_dir).select("page_id", "ord", R.click_tier_wire(F.col("label"), F.col("type")).alias("tier"))


@query(f"WITH {RICH} SELECT page_id, ord, {_COLL('label')} <> '' AND {_COLL('aria')} <> '' AND NOT contains({_COLL('label')}, {_COLL('aria')}) AND NOT contains({_COLL('aria')}, {_COLL('label')}) AS mismatch FROM rich")
def d4_name_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich_controls(spark, sf_dir).select("page_id", "ord", R.name_mismatch(F.col("label"), F.col("aria")).alias("mismatch"))


@query(f"WITH {TIERED} SELECT stricter, unattended, count(*) AS n FROM (SELECT CASE WHEN tier = 'destructive' THEN 'destructive' ELSE 'state-changing' END AS stricter, tier IN ('reversible', 'navigational') AS unattended FROM tiered) GROUP BY ALL")
def d5_stricter_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir)
    return t.groupBy(R.stricter_tier(F.col("tier"), F.lit("state-changing")).alias("stricter"), R.permits_unattended(F.col("tier")).alias("unattended")).agg(F.count("*").alias("n"))


PLANS = """plans AS (SELECT c.conv_id * 100 + c.turn AS plan_id, c.conv_id % 40 AS page_id, (['click', 'type', 'scroll', 'wait', 'finish', 'swipe'])[c.turn % 6 + 1] AS action,
 CASE WHEN c.turn % 4 < 3 THEN '#c' || (c.conv_id + c.turn) % 13 END AS target_selector, CAST(c.turn * 10 AS DOUBLE) AS x, CASE WHEN c.turn % 9 = 8 THEN -1.0 ELSE 5.0 END AS y,
 CASE WHEN c.conv_id % 3 = 0 THEN 'please delete it' ELSE 'read on with EMAIL#1 and PHONE#2' END AS task, c.turn % 8 = 7 AS odd FROM conversations c)"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for every turn: actions, targets and tasks by arithmetic on the keys."""
    conv, turn = F.col("conv_id"), F.col("turn")
    act = F.element_at(F.array(*map(F.lit, ("click", "type", "scroll", "wait", "finish", "swipe"))), (turn % 6 + 1).cast("int"))
    keys = F.array(*map(F.lit, P.ACTION_KEYS))
    return table(spark, sf_dir, "conversations").select(
        (conv * 100 + turn).alias("plan_id"), (conv % 40).alias("page_id"), act.alias("action"), F.when(turn % 4 < 3, F.concat(F.lit("#c"), ((conv + turn) % 13).cast("string"))).alias("target_selector"),
        (turn * 10).cast("double").alias("x"), F.when(turn % 9 == 8, -1.0).otherwise(5.0).alias("y"), F.when(conv % 3 == 0, "please delete it").otherwise("read on with EMAIL#1 and PHONE#2").alias("task"),
        F.when(turn % 8 == 7, F.concat(keys, F.array(F.lit("scene")))).otherwise(keys).alias("keys"),
    )


PLANNED = f"""{TIERED}, {PLANS}, idx AS (SELECT page_id, selector AS target_selector, count(*) AS matches, min(tier) AS found FROM tiered GROUP BY 1, 2),
pt AS (SELECT p.*, coalesce(matches, 0) AS matches, CASE WHEN action NOT IN ('click', 'type', 'scroll', 'wait', 'finish') THEN 'unrecognized-action' WHEN action IN ('click', 'type') AND coalesce(matches, 0) = 0 THEN 'target-not-in-scene'
  WHEN action IN ('click', 'type') AND matches > 1 THEN 'target-ambiguous' END AS tier_error,
 CASE WHEN action IN ('scroll', 'wait', 'finish') THEN 'reversible' WHEN action = 'click' AND matches = 1 THEN found WHEN action = 'type' AND matches = 1 THEN CASE WHEN found = 'destructive' THEN 'destructive' ELSE 'state-changing' END END AS plan_tier
 FROM plans p LEFT JOIN idx USING (page_id, target_selector)),
hd AS (SELECT page_id, bool_or(tier = 'destructive') AS hd FROM tiered GROUP BY page_id)"""


@query(f"WITH {PLANNED} SELECT plan_id, matches, plan_tier, tier_error FROM pt")
def d6_plan_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_tier(plans(spark, sf_dir), tiered(spark, sf_dir)).select("plan_id", "matches", "plan_tier", "tier_error")


CHECKED = f"""{PLANNED}, ck AS (SELECT pt.*, action IN ('click', 'type', 'scroll', 'wait', 'finish') AS c1, NOT odd AS c2, CASE WHEN target_selector IS NULL THEN action NOT IN ('click', 'type') ELSE matches = 1 END AS c3, x >= 0 AND y >= 0 AS c4,
 plan_tier IS NOT NULL AS c5, task <> 'please delete it' OR coalesce(hd, false) AS c6 FROM pt LEFT JOIN hd USING (page_id)),
gated AS (SELECT *, c1 AND c2 AND c3 AND c4 AND c5 AND c6 AS passed, CASE WHEN plan_tier IS NULL OR NOT (c1 AND c2 AND c3 AND c4 AND c5 AND c6) THEN 'reject' WHEN plan_tier = 'destructive' THEN 'ask' WHEN plan_tier = 'state-changing' THEN 'confirm' ELSE 'unattended' END AS gate FROM ck)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_checks(plans(spark, sf_dir).withColumn("overridden", F.lit(False)), tiered(spark, sf_dir))


_FAILED = " || ".join(f"CASE WHEN c{i} THEN '' ELSE '{n},' END" for i, n in enumerate(("action-allowed", "no-unexpected-keys", "selector-in-scene", "coordinates-finite", "tier-computed", "intent-coherence"), 1))


@query(f"WITH {CHECKED} SELECT plan_id, {_FAILED} AS failed, passed FROM gated")
def d7_plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.array_join(F.transform(F.filter("checks", lambda c: ~c["pass"]), lambda c: F.concat(c["name"], F.lit(","))), "")
    return checked(spark, sf_dir).select("plan_id", failed.alias("failed"), "passed")


@query(f"""WITH {PLANNED} SELECT plan_id, CASE WHEN action = 'swipe' THEN 'action-allowed' WHEN odd THEN 'no-unexpected-keys' WHEN target_selector IS NOT NULL AND matches = 0 THEN 'selector-in-scene' END AS failed FROM pt""")
def d8_plan_checks_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_checks_wire(plans(spark, sf_dir), tiered(spark, sf_dir)).select("plan_id", "failed")


@query(f"""WITH {PLANNED} SELECT plan_id, over AS overridden, CASE WHEN over THEN 'finish' ELSE action END AS action FROM (SELECT *, task = 'please delete it' AND NOT coalesce(hd, false) AS over FROM plans LEFT JOIN hd USING (page_id))""")
def d9_intent_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.intent_coherence(plans(spark, sf_dir), tiered(spark, sf_dir)).select("plan_id", "overridden", "action")


@query(f"WITH {CHECKED} SELECT action, gate, count(*) AS count FROM gated GROUP BY ALL")
def d10_gate_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gate_counts(checked(spark, sf_dir), "action")


@query(f"""WITH {TIERED}, v AS (SELECT page_id, ord, tier AS local, (['accept', 'ask', 'reject', 'maybe'])[ord % 4 + 1] AS verdict, (['destructive', 'navigational', 'odd'])[(ord + page_id) % 3 + 1] AS remote FROM tiered),
f AS (SELECT *, CASE WHEN remote = 'odd' THEN local WHEN remote = 'destructive' OR local = 'destructive' THEN 'destructive' WHEN local = 'state-changing' THEN 'state-changing' ELSE 'navigational' END AS final FROM v)
SELECT page_id, ord, CASE WHEN verdict = 'reject' THEN 'reject' WHEN verdict = 'ask' THEN 'ask' WHEN verdict <> 'accept' OR remote = 'odd' OR remote <> local OR final <> 'navigational' THEN 'confirm' ELSE 'unattended' END AS path,
 CASE WHEN verdict = 'reject' THEN local ELSE final END AS final_tier FROM f""")
def d11_gate_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    gate = R.gate_dual(pick(("accept", "ask", "reject", "maybe"), F.col("ord") % 4), pick(("destructive", "navigational", "odd"), (F.col("ord") + F.col("page_id")) % 3), F.col("tier"))
    return tiered(spark, sf_dir).select("page_id", "ord", gate.alias("g")).select("page_id", "ord", "g.path", "g.final_tier")


_RELEASE = """CASE WHEN doc_id % 6 = 5 THEN 'not-a-click' WHEN regex_tier <> 'state-changing' THEN 'decided-by-a-rule' WHEN doc_id % 11 = 3 THEN 'destructive-intent' WHEN doc_id % 13 = 4 THEN 'review-skipped'
 WHEN p_nav < 0.9 THEN 'navigational-too-low' WHEN p_destr >= 0.5 THEN 'destructive-too-high' WHEN p_off >= 0.5 THEN 'off-task-too-high' END"""


def _release_columns() -> dict:
    d, yes = F.col("doc_id"), F.lit(True)
    return {
        "action": F.when(d % 6 == 5, "type").otherwise("click"), "tier": F.col("regex_tier"), "basis": F.lit("unproven"), "intent": d % 11 == 3, "reviewed": yes, "skipped": d % 13 == 4, "verified": yes, "fine_tuned": yes, "same_step": yes,
        "p_nav": F.col("p_nav"), "p_destr": F.col("p_destr"), "p_off": F.col("p_off"),
    }


@query(f"WITH {PREDICTIONS} SELECT doc_id, {_RELEASE} AS refused FROM predictions")
def d12_release_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("doc_id", R.release_refusal(_release_columns()).alias("refused"))


@query(f"WITH {PREDICTIONS} SELECT doc_id, CASE WHEN verdict = 'accept' AND (p_destr >= 0.5 OR p_off >= 0.5) THEN 'ask' ELSE verdict END AS verdict FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'reject' ELSE 'accept' END AS verdict FROM predictions)")
def d13_escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("doc_id") % 4 == 0, "reject").otherwise("accept")
    return predictions(spark, sf_dir).select("doc_id", R.escalate(verdict, F.col("p_destr"), F.col("p_off")).alias("verdict"))


_SAFE = "[" + ", ".join(f"'{x}'" for x in P.SAFE_LABELS) + "]"
SCENES = f"""{RICH}, parts AS (SELECT page_id, page_id % 12 AS k, ord, CASE WHEN page_id % 12 = 3 AND ord < 2 THEN 'cx' WHEN page_id % 12 = 4 AND ord < 2 THEN 'c0' ELSE 'c' || ord END AS id, CASE WHEN page_id % 12 = 5 THEN type WHEN tag = 'a' THEN 'link' ELSE 'button' END AS role,
 CASE WHEN page_id % 12 = 6 THEN label ELSE ({_SAFE})[ord % 11 + 1] END AS label, ord * 10.0 - CASE WHEN page_id % 12 = 7 THEN 15 ELSE 0 END AS x, CASE WHEN page_id % 12 = 8 AND ord = 1 THEN 'other' ELSE (['private', 'media', 'face', 'field', 'password'])[ord % 5 + 1] END AS kind FROM rich)"""


@query(f"""WITH {SCENES} SELECT page_id, CASE WHEN k = 1 THEN 'scheme' WHEN k = 2 THEN 'revision' WHEN k = 9 THEN 'viewport' WHEN bool_or(NOT regexp_full_match(id, 'c[0-9]{{1,4}}')) THEN 'control-id' WHEN bool_or(role NOT IN ('button', 'link')) THEN 'role'
 WHEN bool_or(NOT list_contains({_SAFE}, label)) THEN 'label' WHEN bool_or(kind = 'other') THEN 'region-kind' WHEN bool_or(x < 0) THEN 'rect' WHEN count(DISTINCT id) < count(*) THEN 'duplicate-id' WHEN max(x) + 8 > CASE WHEN k = 10 THEN 20 ELSE 1280 END + 0.01 THEN 'outside-viewport' END AS reason
 FROM parts GROUP BY page_id, k""")
def d14_validate_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes from controls, each page broken in one way or none."""
    k, at = F.col("page_id") % 12, F.col("ord")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    rect = F.struct((at * 10.0 - F.when(k == 7, 15).otherwise(0)).alias("x"), F.lit(5.0).alias("y"), F.lit(8.0).alias("width"), F.lit(8.0).alias("height")).alias("rect")
    control = F.struct(
        F.when((k == 3) & (at < 2), "cx").when((k == 4) & (at < 2), "c0").otherwise(F.concat(F.lit("c"), at)).alias("id"),
        F.when(k == 5, F.col("type")).when(F.col("tag") == "a", "link").otherwise("button").alias("role"),
        F.when(k == 6, F.col("label")).otherwise(pick(P.SAFE_LABELS, at % 11)).alias("label"), rect,
    )
    region = F.struct(F.when((k == 8) & (at == 1), "other").otherwise(pick(P.REGION_KINDS, at % 5)).alias("kind"), rect)
    scenes = rich_controls(spark, sf_dir).groupBy("page_id").agg(F.collect_list(control).alias("controls"), F.collect_list(region).alias("regions"))
    scenes = scenes.withColumns({
        "scheme": F.when(k == 1, "other").otherwise("scene/1"), "revision": F.when(k == 2, "01234567-89ab-0def-8123-456789abcdef").otherwise("01234567-89ab-4def-8123-456789abcdef"),
        "viewport": F.struct(F.when(k == 9, 9000.0).when(k == 10, 20.0).otherwise(1280.0).alias("width"), F.lit(800.0).alias("height")),
    })
    return G.validate_scene(scenes).select("page_id", "reason")


_MADE = f"""{RICH}, placed AS (SELECT page_id, ord, CASE WHEN ord % 3 = 0 THEN label ELSE ({_SAFE})[ord % 11 + 1] END AS label, ord * 100.4 - 5 AS x FROM rich),
c AS (SELECT page_id, greatest(0.0, floor(x)) AS l, least(1280.0, ceil(x + 95)) AS r FROM placed WHERE list_contains({_SAFE}, label)), g AS (SELECT page_id, greatest(0.0, floor(x - 2)) AS l, least(1280.0, ceil(x + 97)) AS r FROM placed WHERE ord % 4 = 1)"""


@query(f"""WITH {_MADE} SELECT page_id, coalesce(n, 0) AS controls, coalesce(w, 0) AS width, coalesce(m, 0) AS regions, coalesce(v, 0) AS hidden FROM (SELECT DISTINCT page_id FROM placed)
 LEFT JOIN (SELECT page_id, count(*) AS n, CAST(sum(r - l) AS BIGINT) AS w FROM c WHERE r > l GROUP BY page_id) USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS m, CAST(sum(r - l) AS BIGINT) AS v FROM g WHERE r > l GROUP BY page_id) USING (page_id)""")
def d15_make_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ord")
    safe = F.element_at(F.array(*map(F.lit, P.SAFE_LABELS)), (at % 11 + 1).cast("int"))
    placed = rich_controls(spark, sf_dir).withColumns({"x": at * 100.4 - 5, "y": F.lit(10.0), "w": F.lit(95.0), "h": F.lit(20.0), "label": F.when(at % 3 == 0, F.col("label")).otherwise(safe), "id": F.concat(F.lit("c"), at), "role": F.lit("button")})
    scene = G.make_scene(placed, placed.where(at % 4 == 1).withColumn("kind", F.lit("field")))
    wide = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["rect"]["width"]).cast("long")
    return scene.select("page_id", F.size("controls").cast("long").alias("controls"), wide("controls").alias("width"), F.size("regions").cast("long").alias("regions"), wide("regions").alias("hidden"))


@query()
def d16_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a document's spans as regions."""
    docs = probed(spark, sf_dir)
    regions = S.spread(D.sensitive_spans(docs), "doc_id", items="spans").select("doc_id", "kind")
    scored = G.risk_score(regions, docs.select("doc_id", (F.col("doc_id") % 3).alias("n_controls")))
    return scored.select("doc_id", "high", "regions", "points", "band")


_MESSAGES = ("Active tab changed since the toolbar", "Either the '<all_urls>' or 'activeTab' permission", "Could not establish connection. Receiving end does not exist.", "Cannot access chrome:// URL", "Paste your local pairing token", "boom")
_CODES = ("navigated_since_gesture", "needs_activeTab", "content_script_missing", "restricted_page", "pairing_token", "other")


@query(f"""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'navigated_since_gesture' ELSE ({list(_CODES)})[event_id % 6 + 1] END AS code, event_id % 17 = 0 OR event_id % 6 <> 3 AS retryable FROM events WHERE event_type = 'error'""")
def d17_classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    got = R.classify_error(F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 6 + 1).cast("int")), F.when(F.col("event_id") % 17 == 0, "navigated_since_gesture"))
    return e.select("event_id", got.alias("g")).select("event_id", "g.code", "g.retryable")


OPTIONS = f"""{RICH}, tasks AS (SELECT page_id, page_id % 2 = 0 AS two FROM pages), o AS (
 SELECT page_id, ord, 0 AS i, CASE WHEN type IN ('button', 'link', 'checkbox', 'radio', 'submit') THEN 'click ' || selector END AS action FROM rich WHERE type IN ('button', 'link', 'checkbox', 'radio', 'submit') AND ord % 3 > 0
 UNION ALL SELECT page_id, ord, t, 'type ' || selector || ' ' || (['EMAIL#1', 'PHONE#2'])[t + 1] FROM rich JOIN tasks USING (page_id), (VALUES (0), (1)) v(t) WHERE ord % 3 = 0 AND (two OR t = 0)
 UNION ALL SELECT page_id, 2147483646, 0, 'finish' FROM tasks UNION ALL SELECT page_id, 2147483647, 0, 'none_of_these' FROM tasks),
options AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) AS INTEGER) AS n, action FROM (SELECT page_id, action, min((ord, i)) AS place FROM o GROUP BY 1, 2))"""


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third control is a text field; tasks hold one token or two."""
    controls = rich_controls(spark, sf_dir).withColumn("type", F.when(F.col("ord") % 3 == 0, "text").otherwise(F.col("type")))
    tasks = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "send PHONE#2 to EMAIL#1 EMAIL#1").otherwise("send EMAIL#1").alias("task"))
    return G.action_options(controls, tasks)


@query(f"WITH {OPTIONS} SELECT page_id, n, action FROM options")
def d18_action_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options(spark, sf_dir)


@query(f"""WITH {OPTIONS}, {PREDICTIONS}, p AS (SELECT doc_id, doc_id % 40 AS page_id, CASE doc_id % 4 WHEN 0 THEN 'finish' WHEN 1 THEN 'none_of_these' WHEN 2 THEN 'click #c1' ELSE 'type #zz EMAIL#1' END AS choice, confidence, free_p FROM predictions)
SELECT doc_id, CASE WHEN o.action IS NULL THEN 'outside-options' WHEN choice = 'none_of_these' THEN 'none-of-these' WHEN free_p >= 0.5 THEN 'needs-free-text' WHEN confidence < 0.9 THEN 'confidence-too-low' ELSE 'accepted' END AS reason
FROM p LEFT JOIN options o ON p.page_id = o.page_id AND p.choice = o.action""")
def d19_fastpath_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    choice = F.when(k == 0, "finish").when(k == 1, "none_of_these").when(k == 2, "click #c1").otherwise("type #zz EMAIL#1")
    preds = predictions(spark, sf_dir).select("doc_id", (F.col("doc_id") % 40).alias("page_id"), choice.alias("choice"), "confidence", "free_p")
    return G.fastpath_decide(preds, options(spark, sf_dir)).select("doc_id", "reason")


@query(f"""WITH {PLANNED} SELECT plan_id, CASE WHEN odd THEN 'unexpected-keys' WHEN action = 'swipe' THEN 'invalid-action' WHEN target_selector IS NOT NULL AND matches = 0 THEN 'target-not-in-scene' END AS refused,
 CASE WHEN NOT odd AND action <> 'swipe' AND (target_selector IS NULL OR matches > 0) THEN x END AS x FROM pt""")
def d20_validate_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.to_json(F.struct("action", "target_selector", F.struct("x", "y").alias("coordinates"), F.when(F.array_contains("keys", "scene"), F.lit(1)).alias("scene")))
    p = plans(spark, sf_dir).withColumn("plan_json", json).select("plan_id", "page_id", "plan_json")
    return G.validate_action(p, tiered(spark, sf_dir)).select("plan_id", "refused", F.col("plan.x").alias("x"))


@query(f"WITH {TIERED} SELECT page_id, ord, tier AS one, wire AS other FROM (SELECT *, {WIRE} AS wire FROM tiered) WHERE tier <> wire")
def d21_rule_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rule_parity(tiered(spark, sf_dir), F.col("tier"), R.click_tier_wire(F.col("label"), F.col("type"))).select("page_id", "ord", "one", "other")


@query("SELECT page_id, split_part(url, '#', 1) = split_part(url || CASE WHEN page_id % 2 = 0 THEN '#top' ELSE '&moved=1' END, '#', 1) AS fresh FROM pages")
def d22_gesture_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as two snapshots: an even one with another fragment, an odd one with another query."""
    pages = table(spark, sf_dir, "pages")
    later = pages.select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, "#top").otherwise("&moved=1")).alias("now"))
    return pages.join(later, "page_id").select("page_id", R.same_page(F.col("url"), F.col("now")).alias("fresh"))


@query(f"WITH {CONTROLS} SELECT page_id, count(*) >= 10 OR (page_id % 5) * 400 * 800 >= 1200000 AS heavy FROM controls GROUP BY page_id")
def d23_heavy_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.parse_controls(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))
    return n.select("page_id", R.heavy_page(F.col("page_id") % 5 * 400, F.lit(800), F.col("n")).alias("heavy"))


@query("SELECT event_id, (['ollama', 'groq', 'groq', 'unknown', 'groq'])[event_id % 5 + 1] AS label FROM events")
def d24_planner_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = ('{"model": "Ollama/7b"}', '{"model": "other"}', '{"error": "GROQ key missing"}', '{"model": ""}', '{"groqConfigured": false}')
    k = F.col("event_id") % 5
    body = F.element_at(F.array(*map(F.lit, bodies)), (k + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", R.planner_label(F.when(k >= 2, 500).otherwise(200), body).alias("label"))


@query()
def b10_classify_form_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls' labels and selectors as names of fields."""
    c = rich_controls(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, ("user_email", "phone", "otp-code", "card number", "cvv", "q"))), (F.col("ord") % 6 + 1).cast("int"))
    kinds = D.classify_form_field(F.col("type"), name, F.lit(""), F.when(F.col("ord") % 2 == 0, "numeric"), F.col("label"))
    return c.groupBy(F.array_join(kinds, ",").alias("kinds")).count()


@query(f"WITH {RICH} SELECT page_id, ord, type IN ('password', 'email', 'tel') OR regexp_matches(label, {quoted(P.PII_LABEL)}) OR regexp_matches(type, {quoted(P.PII_LABEL)}) AS pii FROM rich")
def b11_element_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich_controls(spark, sf_dir).select("page_id", "ord", D.element_pii(F.col("type"), F.col("label")).alias("pii"))


@query(f"WITH {RICH} SELECT page_id, ord, CASE t WHEN 'password' THEN true WHEN 'checkbox' THEN NULL ELSE trim(coalesce(aria, '')) <> '' END AS pii FROM (SELECT *, (['password', 'checkbox', 'text'])[ord % 3 + 1] AS t FROM rich)")
def b12_value_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("password"), F.lit("checkbox"), F.lit("text")), (F.col("ord") % 3 + 1).cast("int"))
    return rich_controls(spark, sf_dir).select("page_id", "ord", D.value_field_pii(kind, F.col("aria")).alias("pii"))
