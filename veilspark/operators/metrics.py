"""Evaluation metrics as grouped aggregates. A ratio without a denominator is null; failed rows stay in denominators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import meeting
from .geometry import interval_iou


def ratio(num: Column, den: Column, digits: int | None = None) -> Column:
    value = F.when(den != 0, num / den)
    return value if digits is None else F.round(value, digits)


def n_if(test: Column) -> Column:
    return F.sum(F.coalesce(test, F.lit(False)).cast("long"))


def covered_length(spans: Column) -> Column:
    """Characters under sorted or unsorted spans, each once."""

    def step(acc: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + new).alias("n"))

    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))))
    return F.aggregate(plain, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])


def shared_spans(a: Column, b: Column) -> Column:
    """Every overlap of a span of ``a`` with one of ``b``."""
    both = lambda s, k: F.struct(F.greatest(s["start"], k["start"]).alias("start"), F.least(s["end"], k["end"]).alias("end"))
    return meeting(b, lambda near: F.flatten(F.transform(a, lambda s: F.transform(near(s), lambda k: both(s, k)))))


def char_coverage(cases: DataFrame, length: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Characters of personal data covered, and others left open, by case; both shares null without such characters."""
    out = cases.withColumn("pii_chars", covered_length(F.col(truth))).withColumn("pred_chars", covered_length(F.col(pred))).withColumn("covered_chars", covered_length(shared_spans(F.col(truth), F.col(pred))))
    out = out.withColumn("open_chars", F.col(length) - F.col("pii_chars")).withColumn("kept_chars", F.col(length) - F.col("pii_chars") - F.col("pred_chars") + F.col("covered_chars"))
    return out.withColumn("coverage", ratio(F.col("covered_chars"), F.col("pii_chars"))).withColumn("preservation", ratio(F.col("kept_chars"), F.col("open_chars")))


def span_prf(cases: DataFrame, truth: str = "truth", pred: str = "pred", least: float = 0.5) -> DataFrame:
    """Span matches by greedy choice in the predictions' order; precision and recall are 1 where both sides are empty.

    A prediction's choices are those true spans that share at least ``least`` (above zero) with it, the best first.
    """

    def choices(near: Callable[[Column], Column]) -> Column:
        scored = lambda p: F.transform(near(p), lambda t: F.struct((-interval_iou(p, t)).alias("s"), t["i"].alias("i")))
        each = F.transform(F.col(pred), lambda p: F.transform(F.array_sort(F.filter(scored(p), lambda x: x["s"] <= -least)), lambda x: x["i"]))
        return F.filter(each, lambda of: F.size(of) > 0)

    def best(used: Column, of: Column) -> Column:
        return F.concat(used, F.slice(F.filter(of, lambda i: ~F.array_contains(used, i)), 1, 1))

    used = F.aggregate(meeting(F.col(truth), choices), F.array().cast("array<int>"), best, F.size)
    out = cases.withColumn("tp", used).withColumn("fp", F.size(pred) - F.col("tp")).withColumn("fn", F.size(truth) - F.col("tp"))
    both = (F.size(truth) == 0) & (F.size(pred) == 0)
    return out.withColumn("precision", F.when(both, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", F.when(F.size(truth) == 0, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fn"))))


def macro_means(cases: DataFrame, ratios: Sequence[str], positive: Column) -> DataFrame:
    """Means of the cases' own ratios that aren't null, over all cases and over those with something to find."""
    return cases.agg(*(F.avg(r).alias(r) for r in ratios), *(F.avg(F.when(positive, F.col(r))).alias(f"{r}_positive") for r in ratios), F.count("*").alias("cases"), n_if(positive).alias("positives"))


def group_annotations(items: DataFrame, sample: str = "sample") -> tuple[DataFrame, DataFrame]:
    """Annotations ``(sample, key, value, x, y, w, h, visible)`` grouped by key and normal value, and excluded ones by reason."""
    norm = F.array_join(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    reason = F.when(~F.coalesce("visible", F.lit(False)), "not-visible").when(F.col("value").isNull() | (norm == ""), "no-text").when(~F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False)), "no-area")
    marked = items.withColumn("reason", reason).withColumn("norm", norm)
    groups = marked.where("reason IS NULL").groupBy(sample, "key", "norm").agg(F.size(F.collect_set(F.struct("x", "y", "w", "h"))).alias("boxes"))
    return groups, marked.where("reason IS NOT NULL").groupBy("reason").count()


def token_multiset_match(expected: DataFrame, actual: DataFrame, keys: Sequence[str], token: str = "token") -> DataFrame:
    """Per group the expected tokens and how many of them the actual ones hold, repeats counted."""
    e = expected.groupBy(*keys, token).agg(F.count("*").alias("e"))
    a = actual.groupBy(*keys, token).agg(F.count("*").alias("a"))
    return e.join(a, [*keys, token], "left").groupBy(*keys).agg(F.sum("e").alias("expected"), F.sum(F.least("e", F.coalesce("a", F.lit(0)))).alias("matched"))


def recovery_report(samples: DataFrame, observed: DataFrame, key: str = "sample") -> DataFrame:
    """Micro ratios over all samples; a sample that failed or is missing counts with nothing recovered."""
    out = samples.join(observed, key, "left").na.fill(0, ["recognized", "marked"]).withColumn("ok", F.coalesce("ok", F.lit(False)))
    good = lambda c: F.sum(F.when(F.col("ok"), F.col(c)).otherwise(0))
    return out.agg(
        F.count("*").alias("samples"), n_if(~F.col("ok")).alias("failed"), F.sum("expected").alias("expected"), good("recognized").alias("recognized"), good("marked").alias("marked"),
        ratio(good("recognized"), F.sum("expected")).alias("recovery"), ratio(good("marked"), F.sum("expected")).alias("protection"),
    )


def validate_observations(observed: DataFrame, contract: DataFrame, key: str = "sample", check: Sequence[str] = ()) -> DataFrame:
    """``observed`` plus ``reason``: a repeated key, one that the contract lacks, or a field that differs from it."""
    n = F.count("*").over(Window.partitionBy(key))
    known = contract.select(key, *(F.col(c).alias(f"want_{c}") for c in check), F.lit(True).alias("known"))
    out = observed.withColumn("_n", n).join(known, key, "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"want_{c}")), f"{c}-differs") for c in check]
    reason = F.coalesce(F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("known").isNull(), "unknown"), *differs)
    return out.withColumn("reason", reason).drop("_n", "known", *(f"want_{c}" for c in check))


def class_metrics(rows: DataFrame, classes: Sequence[str], gold: str = "gold", said: str = "said") -> list[Column]:
    """Aggregates: accuracy, and precision and recall of each class, to four places."""
    g, s = F.col(gold), F.col(said)
    out = [F.count("*").alias("n"), ratio(n_if(g == s), F.count("*"), 4).alias("accuracy")]
    for c in classes:
        name = c.replace("-", "_")
        out += [ratio(n_if((g == c) & (s == c)), n_if(s == c), 4).alias(f"{name}_precision"), ratio(n_if((g == c) & (s == c)), n_if(g == c), 4).alias(f"{name}_recall")]
    return out


def ece(rows: DataFrame, p: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (lo, hi], zero in the first; the bins' sums are all that meets."""
    at = F.coalesce(*(F.when(F.col(p) <= b / bins, b) for b in range(1, bins + 1)))
    per = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(F.col(correct).cast("double")).alias("c"))
    return per.agg(F.round(F.sum(F.abs(F.col("p") - F.col("c"))) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("n"))


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties half, from counts by distinct score. Null if a class is empty.

    Scores are summed over ranges of 1/64 first, so that no task sees more than a range's distinct scores in order.
    """
    counts = rows.groupBy(F.floor(F.col(score) * 64).alias("range"), F.col(score).alias("s")).agg(n_if(F.col(label)).alias("pos"), n_if(~F.col(label)).alias("neg"))
    ranges = counts.groupBy("range").agg(F.sum("neg").alias("rn"))
    below = ranges.withColumn("before", F.coalesce(F.sum("rn").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rn")
    within = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("within", within).join(below, "range")
    total = F.sum(F.col("pos").cast("double") * (F.col("before") + F.col("within") + F.col("neg") / 2))
    return wins.agg(F.round(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), total / (F.sum("pos").cast("double") * F.sum("neg"))), 4).alias("auroc"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def acts(confidence: Column, free_p: Column, threshold: Column) -> Column:
    return F.coalesce((confidence >= threshold) & ~F.coalesce(free_p >= 0.5, F.lit(False)), F.lit(False))


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float], *by: str) -> DataFrame:
    """For each threshold how many rows are acted on, rightly and wrongly, and the accuracy with a fallback for the rest.

    ``rows(confidence, free_p, free_text, correct, fallback)``; thresholds are a short literal list, exploded in place.
    """
    t = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    used = acts(F.col("confidence"), F.col("free_p"), F.col("threshold"))
    right = F.col("correct").cast("double")
    return t.groupBy(*by, "threshold").agg(
        F.count("*").alias("n"), n_if(used).alias("acted"), n_if(used & ~F.col("correct")).alias("wrong"), n_if(used & F.col("free_text")).alias("acted_on_free_text"),
        ratio(n_if(used & F.col("correct")), n_if(used), 4).alias("precision"), ratio(n_if(used), F.count("*"), 4).alias("coverage"),
        F.round(F.avg(F.when(used, right).otherwise(F.col("fallback"))), 3).alias("hybrid_accuracy"), F.round(F.avg("fallback"), 3).alias("fallback_accuracy"),
    )


def escalation_rates(rows: DataFrame, d_min: float = 0.5) -> DataFrame:
    """Destructive steps caught and others asked about, by the rule alone and with the reviewer."""
    bad, rule = F.col("gold") == "destructive", F.col("regex_tier") == "destructive"
    asks = rule | (F.col("p_destr") >= d_min)
    return rows.agg(
        ratio(n_if(rule & bad), n_if(bad), 4).alias("rule_caught"), ratio(n_if(asks & bad), n_if(bad), 4).alias("both_caught"), ratio(n_if(rule & ~bad), n_if(~bad), 4).alias("rule_extra"), ratio(n_if(asks & ~bad), n_if(~bad), 4).alias("both_extra"),
        n_if(bad).alias("destructive"), n_if(~bad).alias("other"),
    )


def release_counts(released: Column, confirmed: Column, gold: str = "gold", key: str = "lang") -> list[Column]:
    """Aggregates of a simulated release: confirmations, releases by true class, and where destructive ones fell."""
    g, r = F.col(gold), confirmed & released
    return [
        n_if(confirmed).alias("confirmations"), n_if(confirmed & (g == "navigational")).alias("truly_navigational"), n_if(r & (g == "navigational")).alias("released_navigational"),
        n_if(r & (g == "state-changing")).alias("released_state_changing"), n_if(r & (g == "destructive")).alias("released_destructive"), F.array_join(F.array_sort(F.collect_set(F.when(r & (g == "destructive"), F.col(key)))), ",").alias("wrong"),
    ]


def ranked(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(g, v, first, end, n)`` by group and distinct value: the places from ``first`` to before ``end`` of ``n`` hold it.

    Groups are structs, which are equal where their nulls are. Counts are summed over 1024 ranges between a group's
    least and most first, so that no task sees more than a range's distinct values in order.
    """
    v = F.col("v").cast("double")
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    edges = counts.groupBy("g").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    inner = F.coalesce(F.floor(F.when(F.col("hi") > F.col("lo"), (v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)) * 1024), F.lit(0))
    at = F.when(F.isnan(v) | (v == float("inf")), 2000).when(v == float("-inf"), -1).otherwise(inner)
    counts = counts.join(edges, "g").select("g", "v", "c", at.alias("range"))
    order = Window.partitionBy("g").orderBy("range")
    ranges = counts.groupBy("g", "range").agg(F.sum("c").alias("rc"))
    ranges = ranges.select("g", "range", (F.sum("rc").over(order) - F.col("rc")).alias("before"), F.sum("rc").over(Window.partitionBy("g")).alias("n"))
    within = F.sum("c").over(Window.partitionBy("g", "range").orderBy("v"))
    out = counts.withColumn("within", within).join(ranges, ["g", "range"])
    end = F.col("before") + F.col("within")
    return out.select("g", "v", (end - F.col("c")).alias("first"), end.alias("end"), "n")


def _at(place: Column) -> Column:
    """Aggregate: the value at a place, counted from zero, among ``ranked`` rows."""
    return F.max(F.when((F.col("first") <= place) & (place < F.col("end")), F.col("v")))


def percentiles(rows: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """One percentile by four rules: nearest rank, linear, rounded index (half to even), floor index."""
    n = F.col("n")
    held = lambda i: F.greatest(F.lit(0), F.least(n - 1, i))
    place = F.lit(p) * (n - 1)
    low, high = F.floor(place), F.ceil(place)
    got = ranked(rows, by, value).groupBy("g").agg(
        _at(held(F.ceil(F.lit(p) * n) - 1)).alias("nearest_rank"), _at(low).alias("lo"), _at(high).alias("hi"), F.max(place - low).alias("part"), _at(held(F.bround(place))).alias("rounded_index"), _at(held(F.floor(F.lit(p) * n))).alias("floor_index")
    )
    linear = F.when(F.col("part") == 0, F.col("lo").cast("double")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part"))
    groups = rows.groupBy(F.struct(*by).alias("g")).agg(F.count("*").alias("_rows"))
    return groups.join(got, "g", "left").select("g.*", "nearest_rank", linear.alias("linear"), "rounded_index", "floor_index")


def latency_summary(rows: DataFrame, lane: str, ms: str = "ms") -> DataFrame:
    return rows.groupBy(lane).agg(F.count(ms).alias("n"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.percentile(ms, F.lit(0.5)).alias("p50_ms"), F.percentile(ms, F.lit(0.95)).alias("p95_ms"), F.avg(ms).alias("mean_ms"))


def stage_p95(rows: DataFrame, *by: str, ms: str = "ms") -> DataFrame:
    """The stage's 95th percentile only where every attempt has it."""
    return rows.groupBy(*by).agg(F.when(F.count(ms) == F.count("*"), F.percentile(ms, F.lit(0.95))).alias("p95_ms"), F.count("*").alias("n"))


def score_attempts(attempts: DataFrame, stages: Sequence[str], lane: str = "L2_full_core") -> DataFrame:
    """``attempts(.., stages map)`` plus whether each is counted at the gate, and why stages are null."""
    missing = F.filter(F.array(*map(F.lit, stages)), lambda s: F.try_element_at("stages_ms", s).isNull())
    ok = (F.col("lane") == lane) & ~F.col("warmup") & (F.col("clock_source") == "extension") & F.col("planner").isin("ollama", "groq") & F.col("gate_ok") & (F.size("missing") == 0) & (F.col("terminal") == "ok")
    return attempts.withColumn("missing", missing).withColumn("include", F.coalesce(ok, F.lit(False)))


def fold_gate_steps(steps: DataFrame, key: str = "attempt_id", order: str = "step") -> DataFrame:
    """An attempt's last step, and whether any step passed the local gate by or ran where its tier needs a person."""
    mild = F.col("local_tier").isin("reversible", "navigational")
    bypass = F.col("bypassed") | ~F.col("computed")
    silent = F.col("unattended") & ~F.coalesce(mild, F.lit(False))
    return steps.groupBy(key).agg(
        F.max_by("local_tier", order).alias("local_tier"), F.max_by("gate", order).alias("gate"), F.bool_or(bypass).alias("bypassed"), F.bool_or(silent).alias("silent"), F.count("*").alias("steps"),
        (~F.bool_or(bypass | silent | F.col("local_tier").isNull())).alias("ok"),
    )


def latency_gate(included: DataFrame, by: str, warmups: str, budget_ms: float = 200.0, least: int = 100, ms: str = "ms") -> DataFrame:
    """Eligible with ten warm-ups and ``least`` samples; passes if its 95th percentile is below the budget."""
    out = included.groupBy(by).agg(F.max(warmups).alias("warmups"), F.count(ms).alias("n"), F.percentile(ms, F.lit(0.95)).alias("p95_ms"))
    out = out.withColumn("eligible", (F.col("warmups") >= 10) & (F.col("n") >= least) & F.col("p95_ms").isNotNull())
    return out.withColumn("status", F.when(F.col("eligible") & (F.col("p95_ms") < budget_ms), "pass").otherwise("fail"))


def latency_breakdown(rows: DataFrame, key: str, planner: Sequence[str], stage: str = "stage", ms: str = "ms", budget_ms: float = 200.0) -> DataFrame:
    """Local stages' sum, the planner's time, and the whole flow; a planner without a time leaves the flow null, which fails."""
    is_planner = F.col(stage).isin(*planner)
    out = rows.groupBy(key).agg(F.sum(F.when(~is_planner, F.col(ms))).alias("local_ms"), F.when(n_if(is_planner & F.col(ms).isNotNull()) > 0, F.sum(F.when(is_planner, F.col(ms)))).alias("planner_ms"))
    out = out.withColumn("flow_ms", F.col("local_ms") + F.col("planner_ms"))
    return out.withColumn("within", F.coalesce(F.col("flow_ms") < budget_ms, F.lit(False)))


def set_prf(expected: DataFrame, observed: DataFrame, key: str, *by: str) -> DataFrame:
    e = expected.select(*by, key).distinct().withColumn("e", F.lit(True))
    o = observed.select(*by, key).distinct().withColumn("o", F.lit(True))
    both = e.join(o, [*by, key], "full")
    tp, fp, fn = n_if(F.col("e") & F.col("o")), n_if(F.col("e").isNull()), n_if(F.col("o").isNull())
    return both.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def points_by_count(rows: DataFrame, count: str, points: str = "points") -> DataFrame:
    """Mean points by number of true kinds (half up to two places)."""
    return rows.groupBy(count).agg(F.count("*").alias("cases"), (F.floor(F.avg(points) * 100 + 0.5) / 100).alias("mean_points"))


def monotonic_share(means: DataFrame, count: str) -> DataFrame:
    """Share of pairs of counts whose means don't fall as the count grows; the table has a row for each count."""
    later = means.select(F.col(count).alias("c2"), F.col("mean_points").alias("m2"))
    pairs = means.join(later, F.col("c2") > F.col(count))
    return pairs.agg(F.count("*").alias("pairs"), (F.floor(ratio(n_if(F.col("m2") >= F.col("mean_points")), F.count("*")) * 1000 + 0.5) / 1000).alias("share"))


def accepted(key: Column, accept: Column) -> Column:
    """Whether a key equals one of the accepted ones; one with a star wants its head and, in either case, its needle."""

    def fits(a: Column) -> Column:
        head, needle = F.trim(F.substring_index(a, "*", 1)), F.regexp_replace(F.regexp_replace(a, r"^[^*]*\*", ""), r"^\*+|\*+$", "")
        return F.when(F.contains(a, F.lit("*")), F.startswith(key, head) & F.contains(F.lower(key), F.lower(needle))).otherwise(a == key)

    return F.exists(accept, fits)


def bench_summary(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, errors, valid and right answers, latency by rounded index, and three samples of errors."""
    g = F.struct(*by).alias("g")
    at = lambda q: F.round(_at(F.bround(F.lit(q) * (F.col("n") - 1))), 1)
    times = ranked(calls, by, "ms").groupBy("g").agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))
    errors = calls.where(F.col("error").isNotNull()).select(g, F.substring("error", 1, 90).alias("e")).distinct()
    errors = errors.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("e"))).where("place <= 3")
    errors = errors.groupBy("g").agg(F.array_join(F.array_sort(F.collect_list("e")), "|").alias("error_samples"))
    out = calls.groupBy(g).agg(F.count("*").alias("calls"), F.count("error").alias("errors"), n_if(F.col("valid")).alias("valid"), n_if(F.col("correct")).alias("correct"))
    out = out.join(times, "g", "left").join(errors, "g", "left")
    return out.select("g.*", "calls", "errors", "valid", "correct", "p50_ms", "p95_ms", F.coalesce("error_samples", F.lit("")).alias("error_samples"))


def ledger_status(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """``rules(id, status, required)`` plus what evidence is missing; a pass without all of it is unknown."""
    need = rules.select("id", F.explode_outer("required").alias("path")).join(evidence.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    missing = need.groupBy("id").agg(n_if(F.col("path").isNotNull() & F.col("there").isNull()).alias("missing"))
    return rules.join(missing, "id").withColumn("status", F.when((F.col("status") == "pass") & (F.col("missing") > 0), "unknown").otherwise(F.col("status")))


def overall_status(ledger: DataFrame) -> DataFrame:
    s = F.col("status")
    overall = F.when(F.bool_or(s == "fail"), "fail").when(F.bool_or(s == "unknown"), "unknown").otherwise("pass")
    return ledger.agg(overall.alias("overall"), *(n_if(s == v).alias(v) for v in ("pass", "fail", "unknown")))


def evidence_freshness(rules: DataFrame, commits: DataFrame, most: int) -> DataFrame:
    """The latest commit that touches a rule's paths, how far behind the head it is, and the status, demoted if too far.

    ``rules(id, status, required)``, ``commits(ord, commit, path)``.
    """
    touched = rules.select("id", F.explode("required").alias("path")).join(commits.groupBy("path").agg(F.max(F.struct("ord", "commit")).alias("c")), "path")
    last = touched.groupBy("id").agg(F.max("c").alias("c"))
    head = commits.agg(F.max("ord")).first()[0]
    out = rules.join(last, "id", "left").withColumn("behind", F.lit(head) - F.col("c.ord"))
    stale = (F.col("status") == "pass") & F.coalesce(F.col("behind") > most, F.lit(True))
    return out.select("id", F.col("c.commit").alias("commit"), "behind", F.when(stale, "unknown").otherwise(F.col("status")).alias("status"))


# The ledger's weights in percent.
RUBRIC = {"visual-context": 25, "pii-detection": 20, "redaction": 20, "task-latency": 20, "presentation": 15}


def rubric_total(observed: DataFrame) -> DataFrame:
    """The weighted total, null unless every metric is observed. ``observed(metric, value)``."""
    weight = F.coalesce(*(F.when(F.col("metric") == k, v) for k, v in RUBRIC.items()))
    return observed.agg(F.count("value").alias("observed"), F.when(F.count("value") == len(RUBRIC), F.sum(F.col("value") * weight) / 100).alias("total"))


def finite_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    fine = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return rows.groupBy(*by).agg(F.count(fine).alias("n"), F.min(fine).alias("least"), F.max(fine).alias("most"), F.avg(fine).alias("mean"))


def temperature_fit(logits: DataFrame, grid: Sequence[float], by: str, least: int = 10) -> DataFrame:
    """Per bucket the temperature of ``grid`` with the least mean negative log-likelihood; 1 for small buckets."""
    t = logits.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    scaled = F.transform("logits", lambda v: v / F.col("t"))
    top = F.array_max("scaled")
    nll = F.log(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top - F.element_at("scaled", F.col("gold") + 1)
    mean = t.withColumn("scaled", scaled).withColumn("nll", nll).groupBy(by, "t").agg(F.avg("nll").alias("nll"), F.count("*").alias("n"))
    best = mean.groupBy(by).agg(F.min_by("t", F.struct("nll", "t")).alias("t"), F.max("n").alias("n"))
    return best.withColumn("temperature", F.when(F.col("n") < least, 1.0).otherwise(F.col("t"))).drop("t")


def impact(rates: DataFrame, *factors: str) -> DataFrame:
    """The product of rates, null if any is unknown."""
    out = F.lit(1.0)
    for f in factors:
        out = out * F.col(f)
    return rates.withColumn("impact", out)


def gated_share(test: Column, least: int) -> Column:
    """A share in percent that is null until enough samples are there."""
    return F.when(F.count("*") >= least, F.round(100 * n_if(test) / F.count("*"), 4))


def benchmark_formulas(rows: DataFrame, *by: str) -> DataFrame:
    """The benchmark's formulas over ``(weight, passed, fault, rating, run, unexpected)``, each null below its least sample.

    Weighted share of passed scenarios; completion of 25 attempts; recovery from 20 faults; anchored ratings (0 to 4, 18
    of them) as an index; the median of three runs; unexpected failures among 1000 requests.
    """
    passed, fault = F.col("passed"), F.col("fault")
    faults = n_if(fault)
    return rows.groupBy(*by).agg(
        F.round(100 * F.sum(F.when(passed, F.col("weight")).otherwise(0)) / F.sum("weight"), 4).alias("functionality"), gated_share(passed, 25).alias("completion"), F.when(faults >= 20, F.round(100 * n_if(fault & passed) / faults, 4)).alias("recovery"),
        F.when(F.count("rating") >= 18, F.round(100 * F.avg("rating") / 4, 4)).alias("narrative"), F.when(F.count("run") >= 3, F.round(F.median("run"), 6)).alias("median_run"), gated_share(F.col("unexpected"), 1000).alias("unexpected_failure"),
    )


OUTCOMES = ("unaided", "with_help", "fail")


def review_log_check(people: DataFrame, reviewers: DataFrame, tasks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables plus ``reasons``, every one that a row is refused for, empty for a valid row.

    ``people(id, non_author, date_utc, tasks map)``, ``reviewers(id, rubric_score, date_utc)``.
    """
    said = lambda rules: F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), name + ",") for name, test in rules))), "")
    undated = F.coalesce("date_utc", F.lit("")) == ""
    results = [~F.coalesce(F.try_element_at("tasks", F.lit(t)).isin(*OUTCOMES), F.lit(False)) for t in tasks]
    unfinished = F.exists(F.array(*results), lambda x: x)
    p = people.withColumn("reasons", said((("id", ~F.startswith("id", F.lit("P"))), ("author", ~F.col("non_author")), ("date", undated), ("task", unfinished))))
    r = reviewers.withColumn("reasons", said((("id", ~F.startswith("id", F.lit("R"))), ("score", ~F.col("rubric_score").isin(1, 2, 3, 4, 5)), ("date", undated))))
    return p, r


def review_outcomes(people: DataFrame, reviewers: DataFrame, least_people: int = 5, least_reviewers: int = 3) -> DataFrame:
    """``(task, unaided, with_help, fail, met)`` of valid sessions; ``met`` if enough people and reviewers are valid."""
    valid = people.where("reasons = ''")
    enough = reviewers.where("reasons = ''").agg((F.count("*") >= least_reviewers).alias("rated"))
    counts = valid.select(F.explode("tasks").alias("task", "result")).groupBy("task").agg(*(n_if(F.col("result") == o).alias(o) for o in OUTCOMES), F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(enough)).withColumn("met", (F.col("n") >= least_people) & F.col("rated")).drop("n", "rated")


def fixture_token_score(expected: DataFrame, words: DataFrame, key: str, least: float = 70.0) -> DataFrame:
    """Per image: tokens of personal data, how many were detected and retained, and useful tokens that were retained.

    A word belongs to the expected box that holds its centre; a token is recognised if the letters and digits of its
    words, in the order of their ids, are its own. ``expected(key, box_id, text, pii, box)``, ``words(key, box_id, text,
    sensitive, confidence, box)``.
    """
    plain = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "")
    read = words.select(key, F.col("box_id").alias("word_id"), plain("text").alias("word"), "sensitive", F.col("confidence").alias("sure"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    held = F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h"))
    got = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word_id").isNotNull(), F.struct("word_id", "word")))), lambda x: x["word"]), "")
    pairs = expected.join(read.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & held, "left")
    out = pairs.groupBy(*expected.columns).agg(got.alias("got"), F.bool_or("sensitive").alias("any"), F.bool_and(~F.col("sensitive") & (F.col("sure") >= least)).alias("open"))
    out = out.withColumn("ok", F.col("got") == plain("text"))
    found, kept = F.col("ok") & F.coalesce("any", F.lit(False)), F.col("ok") & F.coalesce("open", F.lit(True))
    pii = F.col("pii")
    return out.groupBy(key).agg(n_if(pii).alias("pii_tokens"), n_if(pii & found).alias("pii_detected"), n_if(pii & kept).alias("pii_retained"), n_if(~pii).alias("useful_tokens"), n_if(~pii & kept).alias("useful_retained"))
