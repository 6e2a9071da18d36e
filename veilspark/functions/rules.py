"""Rules that tier and gate actions, as columns. Tiers are ordered; an unknown one is never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import composed


def tier_rank(tier: Column) -> Column:
    """Place of a tier from 1, 0 for an unknown or missing one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, P.TIERS)), tier), F.lit(0))


def stricter_tier(a: Column, b: Column) -> Column:
    """The stricter of two known tiers, null if either is unknown."""
    return F.when((tier_rank(a) > 0) & (tier_rank(b) > 0), F.when(tier_rank(a) >= tier_rank(b), a).otherwise(b))


def permits_unattended(tier: Column) -> Column:
    return F.coalesce(tier.isin("reversible", "navigational"), F.lit(False))


def _shown(text: Column) -> Column:
    """Canonical composition, then zero-width characters removed: what every rule reads. Labels and tasks are short."""
    return F.regexp_replace(composed(F.coalesce(text, F.lit(""))), P.ZERO_WIDTH, "")


def slugs_as_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(_shown(text), r"[\s\-_/.?=&+#:%]+", " "))


def collapsed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_shown(text), r"\s+", " ")))


def destructive_intent(task: Column) -> Column:
    return _shown(task).rlike(P.DESTRUCTIVE_INTENT)


def name_mismatch(visible: Column, accessible: Column) -> Column:
    """Both names are there and neither holds the other."""
    a, b = collapsed(visible), collapsed(accessible)
    return (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)


def click_tier(fields: dict[str, Column]) -> Column:
    """``(tier, basis)`` of clicking a control, from all strings that describe it; the first rule that applies.

    ``fields``: visible, aria, title, value, placeholder, form_action, formaction, href, type, submits (boolean).
    """
    get = lambda k: fields.get(k, F.lit(None).cast("string"))
    # fields are read at once, parted by a character that no rule's pattern holds
    reads = lambda names, regex: slugs_as_words(F.concat_ws("\x01", *map(get, names))).rlike(regex)
    every = ("visible", "aria", "title", "value", "placeholder", "form_action", "formaction", "href", "type")
    filled = lambda *names: F.coalesce(*(F.nullif(get(n), F.lit("")) for n in names), F.lit(""))
    is_ = lambda tier, basis: F.struct(F.lit(tier).alias("tier"), F.lit(basis).alias("basis"))
    return (
        F.when(reads(every, P.DESTRUCTIVE_LABEL), is_("destructive", "destructive-keyword"))
        .when(reads(("visible", "aria", "title", "value", "type"), P.SUBMIT_LABEL), is_("state-changing", "submit-keyword"))
        .when(F.coalesce(fields.get("submits", F.lit(False)), F.lit(False)), is_("state-changing", "submits-form"))
        .when(name_mismatch(get("visible"), filled("aria", "title")), is_("state-changing", "name-mismatch"))
        .when(collapsed(filled("aria", "visible", "title", "value")).rlike(P.NAVIGATION_LABEL), is_("navigational", "navigation-label"))
        .otherwise(is_("state-changing", "unproven"))
    )


def click_tier_wire(label: Column, field_type: Column) -> Column:
    """The tier from a label and a field type alone; navigation is read from the label only."""
    both = _shown(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), F.coalesce(field_type, F.lit(""))))
    return (
        F.when(both.rlike(P.DESTRUCTIVE_LABEL), "destructive")
        .when(both.rlike(P.SUBMIT_LABEL), "state-changing")
        .when(F.trim(_shown(label)).rlike(P.NAVIGATION_LABEL), "navigational")
        .otherwise("state-changing")
    )


def gate_local(passed: Column, tier: Column) -> Column:
    return (
        F.when((tier_rank(tier) == 0) | ~F.coalesce(passed, F.lit(False)), "reject")
        .when(tier == "destructive", "ask")
        .when(~permits_unattended(tier), "confirm")
        .otherwise("unattended")
    )


def gate_dual(verdict: Column, remote: Column, local: Column) -> Column:
    """``(path, final_tier, reasons)`` of a remote verdict and two tiers; never looser than the local one."""
    known = tier_rank(remote) > 0
    final = F.when(known, stricter_tier(remote, local)).otherwise(local)
    reasons = F.array_compact(
        F.array(
            F.when(~verdict.eqNullSafe("accept"), "verdict-not-accept"),
            F.when(~known, "remote-tier-unknown").when(remote != local, "tiers-differ"),
            F.when(~permits_unattended(final), "tier-needs-confirmation"),
        )
    )
    none = F.array().cast("array<string>")
    out = lambda path, tier, why: F.struct(path.alias("path"), tier.alias("final_tier"), why.alias("reasons"))
    return (
        F.when(tier_rank(local) == 0, out(F.lit("reject"), F.lit(None).cast("string"), F.array(F.lit("no-local-tier"))))
        .when(verdict.eqNullSafe("reject"), out(F.lit("reject"), local, none))
        .when(verdict.eqNullSafe("ask"), out(F.lit("ask"), final, none))
        .otherwise(out(F.when(F.size(reasons) > 0, "confirm").otherwise("unattended"), final, reasons))
    )


def is_probability(p: Column) -> Column:
    return F.coalesce(~F.isnan(p) & (p >= 0) & (p <= 1), F.lit(False))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that refuses (a null test refuses nothing); null if none does."""
    return F.coalesce(*(F.when(test, name) for name, test in rules))


# What releases a confirmation.
MIN_NAVIGATIONAL, MAX_DESTRUCTIVE, MAX_OFF_TASK = 0.9, 0.5, 0.5


def release_refusal(c: dict[str, Column]) -> Column:
    """Why a confirmation isn't released, null if it is: the first of the refusals, then of the thresholds."""
    return first_reason(
        (
            ("not-a-click", ~c["action"].eqNullSafe("click")),
            ("decided-by-a-rule", ~(c["tier"].eqNullSafe("state-changing") & c["basis"].eqNullSafe("unproven"))),
            ("destructive-intent", F.coalesce(c["intent"], F.lit(False))),
            ("no-review", ~F.coalesce(c["reviewed"], F.lit(False))),
            ("review-skipped", F.coalesce(c["skipped"], F.lit(False))),
            ("not-verified", ~F.coalesce(c["verified"], F.lit(False))),
            ("other-checkpoint", ~F.coalesce(c["fine_tuned"], F.lit(False))),
            ("other-step", ~F.coalesce(c["same_step"], F.lit(False))),
            ("unusable-probability", ~(is_probability(c["p_nav"]) & is_probability(c["p_destr"]) & is_probability(c["p_off"]))),
            ("navigational-too-low", c["p_nav"] < MIN_NAVIGATIONAL),
            ("destructive-too-high", c["p_destr"] >= MAX_DESTRUCTIVE),
            ("off-task-too-high", c["p_off"] >= MAX_OFF_TASK),
        )
    )


def escalate(verdict: Column, p_destr: Column, p_off: Column, d_min: float = 0.5, o_min: float = 0.5) -> Column:
    """An accepted step becomes a question when the reviewer's fears are high; nothing becomes a rejection."""
    feared = (F.coalesce(p_destr, F.lit(0.0)) >= d_min) | (F.coalesce(p_off, F.lit(0.0)) >= o_min)
    return F.when((verdict == "accept") & feared, "ask").otherwise(verdict)


def classify_error(message: Column, code: Column) -> Column:
    """``(code, human_action, retryable)`` of a capture error: its own code if it is known, else its message's class."""
    out = lambda c, a, r: F.struct(F.lit(c).alias("code"), F.lit(a).alias("human_action"), F.lit(r).alias("retryable"))
    first = P.ERROR_CLASSES[0]
    cases = F.when(code.eqNullSafe(first[0]), out(*first[:3]))
    for name, action, again, regex in P.ERROR_CLASSES:
        cases = cases.when(F.coalesce(message, F.lit("unknown")).rlike(regex), out(name, action, again))
    return cases.otherwise(out("other", "retry_capture", True))


def same_page(a: Column, b: Column) -> Column:
    """Equal but for the fragment."""
    return F.substring_index(a, "#", 1) == F.substring_index(b, "#", 1)


def heavy_page(width: Column, height: Column, regions: Column) -> Column:
    return (width * height >= P.HEAVY_PIXELS) | (regions >= P.HEAVY_REGIONS)


def planner_label(status: Column, body: Column) -> Column:
    model, error = (F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in ("model", "error"))
    ok = status.between(200, 299)
    local = model.rlike("(?i)ollama|11434")
    hosted = F.concat(error, F.lit("\n"), model).rlike("(?i)groq") | (F.get_json_object(body, "$.groqConfigured") == "false") | (ok & (model != "") & ~local)
    return F.when(ok & local, "ollama").when(hosted, "groq").otherwise("unknown")
