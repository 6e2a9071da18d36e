"""Redaction and tokens: one token per value of a scope, planned over all its sources, then rendered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scan
from ..functions import spans as S
from . import matching as M
from .numbering import numbered

STRIP_THRESHOLD = 0.60
FLOOR, FLOOR_BY_LABEL = 0.35, {"person name": 0.12}
MASK = "<mask-pii/>"
PARTER = "\u2060"


def masked_text(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with every span replaced by the mask, the number of spans, and what each was (never its value)."""
    what = F.transform(spans, lambda s: F.struct(s["kind"].alias("pattern"), (s["end"] - s["start"]).alias("length"), F.lit(1.0).alias("confidence")))
    put = S.rendered(F.col(text), F.col(spans), lambda s: F.lit(MASK))
    return docs.withColumns({"masked": put, "n_masked": F.size(spans), "decisions": what}).drop(text, spans)


def tokenized_by_occurrence(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The older rule: a new token for every occurrence, numbered by type in the order of the passes."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["pass"].alias("p"), s["start"].alias("a"), s["end"].alias("e"), s["kind"].alias("k"))))
    of_kind = lambda o, k: F.transform(F.filter(o, lambda x: x["k"] == k), lambda x, i: F.struct(x["a"].alias("start"), x["e"].alias("end"), F.concat(F.upper(k), F.lit("#"), (i + 1).cast("string")).alias("token")))
    numbered_by_kind = S.let(order, lambda o: F.array_sort(F.flatten(F.transform(F.array_distinct(F.transform(o, lambda x: x["k"])), lambda k: of_kind(o, k)))))
    docs = docs.withColumn("_numbered", numbered_by_kind)
    put = S.rendered(F.col(text), F.col("_numbered"), lambda s: s["token"])
    return docs.withColumn("tokenized", put).drop(text, spans, "_numbered")


def mint_tokens(spans: DataFrame, scope: str = "scope", source: str = "source_ord") -> DataFrame:
    """The vault ``(scope, type, value, token, n)``: numbers by first occurrence over the scope's sources, per type.

    ``spans(scope, source_ord, start, type, value)``. Repeats are combined before any shuffle of a scope's rows.
    """
    first = spans.groupBy(scope, "type", "value").agg(F.min(F.struct(F.col(source).alias("o"), F.col("start").alias("a"))).alias("first"))
    placed = numbered(first.select(scope, "type", "value", F.col("first.o").alias("first_source"), F.col("first.a").alias("_start")), [scope, "type"], "first_source", ["_start", "value"])
    n = (F.col("_place") + 1).cast("int")
    return placed.select(scope, "type", "value", F.concat_ws("#", "type", n.cast("string")).alias("token"), n.alias("n"), "first_source")


def merge_layers(regex: DataFrame, model: DataFrame, key: str = "doc_id") -> DataFrame:
    """Both layers' spans by key: a model's span that overlaps a regex one, or a model's accepted before it, goes.

    ``(key, start, end, type, value, label, score)``; the model's are taken in their order of start.
    """
    fields = ("start", "end", "type", "value", "label", "score")
    pack = lambda df, layer: df.select(key, F.struct(F.lit(0 if layer == "regex" else 1).alias("o"), *fields, F.lit(layer).alias("layer")).alias("s"))
    both = pack(regex, "regex").unionByName(pack(model, "model")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("spans"))
    kind = both.schema["spans"].dataType.simpleString()
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("at"), s["o"].alias("o"), s.alias("s"))))
    clear = F.transform(S.clear_of(by_start, lambda x: x["o"] == 0, lambda x: x["s"]), lambda x: x["s"])
    both = both.withColumn("spans", clear)
    kept = F.concat(F.filter("spans", lambda s: s["o"] == 0), S.disjoint(F.filter("spans", lambda s: s["o"] == 1), kind))
    return S.spread(both, key, items=kept).drop("o")


def band(score: Column, label: Column, layer: Column) -> Column:
    """``certain``, ``uncertain`` or ``ignored``, by the label's own floor."""
    floor = F.coalesce(*(F.when(label == k, v) for k, v in FLOOR_BY_LABEL.items()), F.lit(FLOOR))
    return F.when((layer == "regex") | (score >= STRIP_THRESHOLD), "certain").when(score >= floor, "uncertain").otherwise("ignored")


def with_model(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rules' spans of ``docs(key, text, spans)`` and those of any span model ``(key, start, end, label, score)``, merged
    as by :func:`merge_layers` and banded: ``(key, start, end, type, value, label, score, layer, band)``.

    A model's spans of one document meet its text as one row, so a long text isn't read again for each of them.
    """
    named = F.upper(F.regexp_replace("label", "[^A-Za-z0-9]", "")).alias("type")
    whole = "bigint" if "bigint" in (model.schema["start"].dataType.simpleString(), model.schema["end"].dataType.simpleString()) else "int"
    place = lambda s: [s["start"].cast(whole).alias("start"), s["end"].cast(whole).alias("end")]
    said = F.struct(*place({"start": F.col("start"), "end": F.col("end")}), named, "label", F.col("score").cast("double").alias("score"))
    model = model.where("start IS NOT NULL AND end IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(said)).alias("_said"))
    both = docs.select(key, text, F.coalesce("spans", S.no_spans()).alias("_rules")).join(model, key, "left")
    both = both.withColumn("_said", F.coalesce("_said", F.array().cast(model.schema["_said"].dataType))).withColumn("_kept", scan.beside(F.col(text), F.col("_rules"), F.col("_said")))
    item = lambda s, type_, value, label, score, layer: F.struct(*place(s), type_.alias("type"), value.alias("value"), label.alias("label"), score.alias("score"), F.lit(layer).alias("layer"))
    rules = F.transform("_rules", lambda s: item(s, F.upper(s["kind"]), s["value"], s["kind"], F.lit(1.0), "regex"))
    kept = F.transform("_kept", lambda k: S.let(F.get("_said", k["i"]), lambda s: item(s, s["type"], k["value"], s["label"], s["score"], "model")))
    return S.spread(both, key, items=F.concat(rules, kept)).withColumn("band", band(F.col("score"), F.col("label"), F.col("layer")))


def propagate_certain(spans: DataFrame, scope: str = "scope") -> DataFrame:
    """``spans(.., band)`` plus ``certain``: whether the value is certain anywhere in its scope."""
    sure = spans.where("band = 'certain'").select(scope, "type", "value").distinct().withColumn("certain", F.lit(True))
    return spans.join(sure, [scope, "type", "value"], "left").withColumn("certain", F.coalesce("certain", F.lit(False)))


def apply_answers(spans: DataFrame, vault: DataFrame, answers: DataFrame, scope: str = "scope") -> DataFrame:
    """Spans with their token and decision: replaced if certain or answered strip, left if keep, asked otherwise."""
    out = spans.join(vault.select(scope, "type", "value", "token"), [scope, "type", "value"]).join(answers, [scope, "token"], "left")
    decision = F.when(F.col("certain") | (F.col("answer") == "strip"), "replace").when(F.col("answer") == "keep", "leave").otherwise("ask")
    return out.withColumn("decision", decision)


def uncertain_questions(spans: DataFrame, scope: str = "scope") -> DataFrame:
    """One row per token to ask about: its top score, its first source and label."""
    return spans.where("decision = 'ask'").groupBy(scope, "token").agg(
        F.round(F.max("score"), 4).alias("score"), F.min_by("source_ord", F.struct("source_ord", "start")).alias("source"), F.max_by("label", F.struct("score", -F.col("source_ord"), -F.col("start"))).alias("label"), F.count("*").alias("n")
    )


def decisions(spans: DataFrame, scope: str = "scope") -> DataFrame:
    """One row per token and source that was replaced: the first occurrence's pattern, layer and score; no value."""
    done = spans.where("decision = 'replace'")
    return done.groupBy(scope, "token", "source_ord").agg(F.min_by(F.struct("label", "layer", "score"), "start").alias("d")).select(scope, "token", "source_ord", "d.*")


def _parted(gap: Column, before: Column, after: Column) -> Column:
    """Text between tokens, so that none but they read as tokens: a mark parts what would, and is itself doubled."""
    doubled = F.replace(gap, F.lit(PARTER), F.lit(PARTER * 2))
    marked = S.let(doubled, lambda d: F.when(F.contains(d, F.lit("#")), F.regexp_replace(d, "([A-Z0-9]#)(?=[0-9])", f"$1{PARTER}")).otherwise(d))
    first, last = (lambda m, at=at: F.substr(m, F.lit(at), F.lit(1)) for at in (1, -1))
    mark = lambda test: F.when(test, PARTER).otherwise("")
    return S.let(marked, lambda m: F.concat(mark(before & first(m).rlike("[0-9]")), m, mark(after & last(m).rlike("[A-Z0-9]"))))


def render(sources: DataFrame, spans: DataFrame, scope: str = "scope", source: str = "source_ord", text: str = "text", keep: bool = False) -> DataFrame:
    """Each source's text with its replaced spans as tokens; sources without any stay as they are. Where a token would
    run into the text around it, or that text reads as one, a word joiner (``PARTER``) stands between. With ``keep`` the
    text stays beside it."""
    planned = spans.where("decision = 'replace'").groupBy(scope, source).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("planned"))
    out = sources.join(planned, [scope, source], "left")
    put = S.rendered(F.col(text), F.col("planned"), lambda s: s["token"], _parted)
    return out.withColumn("rendered", F.coalesce(put, _parted(F.col(text), F.lit(False), F.lit(False)))).drop("planned", *([] if keep else [text]))


def rehydrate(texts: DataFrame, vault: DataFrame, scope: str = "scope", text: str = "rendered", by: Sequence[str] = ()) -> DataFrame:
    """Tokens back to values; a text with a token that its scope doesn't know is rejected (``rejected``, null text).

    Each different text of a scope looks up its own tokens, so that no row holds more of the vault than a text names. ``by``
    are columns that tell a scope's texts apart, its digest if there are none: texts that are dealt out by scope and these,
    as rendered ones are by their source, meet their values where they are.
    """
    found = F.regexp_extract_all(text, F.lit(P.VAULT_TOKEN), F.lit(0))
    own_by = [scope, *(by or ["_digest"])]
    placed = texts.withColumn("_digest", F.sha2(F.col(text), 256))
    if by:  # what the join would ask of one side is asked of both, so that both read the texts as dealt out once
        has_place = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in own_by))
        placed = texts.where(has_place)
    named = placed.select(*own_by, F.explode(F.array_distinct(found)).alias("token"))
    named = named if by else named.distinct()
    own = named.join(vault.select(scope, "token", "value"), [scope, "token"]).groupBy(*own_by).agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("vault"))
    out = placed.join(own, own_by, "left").drop("_digest")
    if by:
        out = out.unionByName(texts.where(~has_place), allowMissingColumns=True)
    known = F.coalesce(F.col("vault"), F.create_map().cast("map<string,string>"))
    bad = F.exists(found, lambda t: F.try_element_at(known, t).isNull())
    back = S.rebuilt(F.col(text), P.VAULT_TOKEN, lambda t: F.try_element_at(known, t), lambda g: F.regexp_replace(g, f"{PARTER}({PARTER}?)", "$1"))
    return out.withColumn("rejected", bad).withColumn("restored", F.when(~bad, back)).drop("vault")


def replace_known_values(labels: DataFrame, vault: DataFrame, scope: str = "scope", label: str = "label") -> DataFrame:
    """Labels with every known value of their scope as its token: longest first, whole words, in one pass.

    A value is bounded only where it begins or ends with a word's character, so a name never changes a longer one.
    """
    known = vault.where("value <> ''").groupBy(scope, "value").agg(F.min("token").alias("token"))
    word = r"[\p{L}\p{N}_]"
    found = M.occurrences(labels, known, scope, label).join(known, [scope, "value"]).select(scope, "text", "value", "token", F.explode("starts").alias("start"))
    found = found.withColumn("end", F.col("start") + F.length("value"))
    at = lambda place: F.substr("text", place, F.lit(1))
    opens = ~F.substr("value", F.lit(1), F.lit(1)).rlike(word) | (F.col("start") == 0) | ~at(F.col("start")).rlike(word)
    closes = ~F.substr("value", F.lit(-1), F.lit(1)).rlike(word) | ~at(F.col("end") + 1).rlike(word)
    spans = found.where(opens & closes).groupBy(scope, F.col("text").alias(label)).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("n"), "end", "token"))).alias("_spans"))
    taken = S.disjoint(F.col("_spans"), spans.schema["_spans"].dataType.simpleString())
    out = labels.join(spans.withColumn("_spans", taken), [scope, label], "left")
    put = S.rendered(F.col(label), F.col("_spans"), lambda s: s["token"])
    return out.withColumn("new_label", F.when(F.col("_spans").isNull(), F.col(label)).otherwise(put)).select(*labels.columns, "new_label")


def replace_substring_values(labels: DataFrame, vault: DataFrame, scope: str = "scope", label: str = "label") -> DataFrame:
    """The looser rule: any place of a value of two characters at least, longest first."""
    known = vault.where(F.length("value") >= 2).groupBy(scope, "value").agg(F.min("token").alias("token"))
    parts = known.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value", "token"))).alias("v"))
    out = labels.join(parts, scope, "left")
    put = F.aggregate("v", F.col(label), lambda acc, x: F.replace(acc, x["value"], x["token"]))
    return out.withColumn("new_label", F.coalesce(put, F.col(label))).drop("v")


def replaced_rows(decided: DataFrame, answers: DataFrame, vault: DataFrame, scope: str = "scope") -> DataFrame:
    """``(scope, token, type, source, layer, score)``; a model's span answered strip is the user's.

    A scope without any decision has one row per token of its vault, all else unknown.
    """
    kind = F.substring_index("token", "#", 1)
    rows = decided.dropDuplicates([scope, "token", "source_ord"]).join(answers, [scope, "token"], "left")
    layer = F.when((F.col("answer") == "strip") & (F.col("layer") != "regex"), "user").otherwise(F.col("layer"))
    rows = rows.select(scope, "token", kind.alias("type"), F.col("source_ord").cast("long").alias("source"), layer.alias("layer"), "score")
    rest = vault.join(decided.select(scope).distinct(), scope, "left_anti")
    return rows.unionByName(rest.select(scope, "token", kind.alias("type"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("string").alias("layer"), F.lit(None).cast("double").alias("score")))


def leak_check(bodies: DataFrame, values: DataFrame, key: str, text: str = "text", value: str = "value") -> DataFrame:
    """Occurrences, in either case, of each known value in the bodies of its scope; values without any have zero.

    A body is dealt out once, in its lower case; only counts leave the tasks that search it.
    """
    known = values.select(key, value).distinct().withColumn("_needle", F.lower(value))
    held = bodies.withColumn("_hay", F.lower(text)).drop(text)
    found = M.occurrences(held, known, key, "_hay", "_needle", keep=()).select(key, F.col("value").alias("_needle"), M.apart(F.col("starts"), F.length("value")).alias("_n"))
    counts = found.groupBy(key, "_needle").agg(F.sum("_n").alias("n"))
    return known.join(counts, [key, "_needle"], "left").select(key, value, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mask_boxes(fields: DataFrame, key: str, group: str) -> DataFrame:
    """One rectangle around each control's or match's boxes ``(x, y, w, h)``, with its kind and how sure it is."""
    return fields.groupBy(key, group, "kind").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.when(F.max("confidence") >= 0.98, "high").otherwise("low").alias("confidence")
    )
