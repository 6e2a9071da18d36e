"""Queries of redaction and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import spans as S
from ..operators import detection as D
from ..operators import tokens as K
from ..sources import tables as A
from ..sources.shared import written
from .inputs import BOXES, PROBED, boxes, probed, table, texts
from .registry import query


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed spans of probed documents; a source of documents is a scope, its documents the scope's sources."""
    rows = S.spread(D.document_spans(probed(spark, sf_dir)), F.col("source").alias("scope"), F.col("doc_id").alias("source_ord"), items="spans")
    return rows.select("scope", "source_ord", "start", "end", F.upper("kind").alias("type"), "value", F.col("kind").alias("label"), F.lit(1.0).alias("score"), F.lit("regex").alias("layer"))


def _model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's spans as a table: capitalised words of texts, their score from place and id."""
    hit = scan.hits(F.col("text"), r"[A-Z][a-z]{4,7}(?![A-Za-z])")
    rows = S.spread(texts(spark, sf_dir), F.col("source").alias("scope"), F.col("doc_id").alias("source_ord"), items=hit)
    label = F.when(F.col("start") % 2 == 0, "person name").otherwise("city")
    return rows.select("scope", "source_ord", "start", "end", F.when(label == "city", "CITY").otherwise("PERSONNAME").alias("type"), "value", label.alias("label"), ((F.col("start") * 7 + F.col("source_ord")) % 100 / 100.0).alias("score"), F.lit("model").alias("layer"))


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_spans(spark, sf_dir).withColumn("band", K.band(F.col("score"), F.col("label"), F.col("layer"))).where("band <> 'ignored'")
    return K.propagate_certain(rows)


def _answers(vault: DataFrame) -> DataFrame:
    return vault.where("n % 3 > 0").select("scope", "token", F.when(F.col("n") % 3 == 1, "strip").otherwise("keep").alias("answer"))


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spans = _banded(spark, sf_dir)
    vault = K.mint_tokens(spans)
    answers = _answers(vault)
    return K.apply_answers(spans, vault, answers), vault, answers


@query()
def c1_mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.masked_text(D.document_spans(probed(spark, sf_dir)))
    return out.select("doc_id", "n_masked", F.md5("masked").alias("digest"), F.size("decisions").alias("n_decisions"))


@query()
def c2_tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tokenized_by_occurrence(D.document_spans(probed(spark, sf_dir))).select("doc_id", F.md5("tokenized").alias("digest"))


_EMAILS = f"""WITH {PROBED}, e AS (SELECT source AS scope, doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS value,
 unnest(range(0, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')))) AS i FROM probed),
f AS (SELECT scope, value, min((doc_id, i)) AS first FROM e GROUP BY scope, value),
vault AS (SELECT scope, value, row_number() OVER (PARTITION BY scope ORDER BY first) AS n FROM f)"""


@query(_EMAILS + " SELECT scope, md5(value) AS value, 'EMAIL#' || n AS token FROM vault")
def c3_mint_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of e-mail addresses by source, in reading order."""
    vault = K.mint_tokens(_spans(spark, sf_dir).where("type = 'EMAIL'"))
    return vault.select("scope", F.md5("value").alias("value"), "token")


@query()
def c4_merge_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col("source_ord").alias("doc_id"), "start", "end", "type", "value", "label", "score"]
    merged = K.merge_layers(_spans(spark, sf_dir).select(*cols), _model_spans(spark, sf_dir).select(*cols))
    return merged.groupBy("doc_id", "layer", "type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))




@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS p, unnest(range(0, len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')))) AS i FROM documents),
o AS (SELECT doc_id, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w),
h AS (SELECT doc_id, CAST(pos + length(p) - length(regexp_extract(p, '[A-Z][a-z]{4,7}$')) AS BIGINT) AS start FROM o WHERE regexp_matches(p, '[A-Z][a-z]{4,7}$')), s AS (SELECT start % 2 = 0 AS name, (start * 7 + doc_id) % 100 / 100.0 AS score FROM h)
SELECT CASE WHEN score >= 0.6 THEN 'certain' WHEN score >= CASE WHEN name THEN 0.12 ELSE 0.35 END THEN 'uncertain' ELSE 'ignored' END AS band, CASE WHEN name THEN 'person name' ELSE 'city' END AS label, count(*) AS n FROM s GROUP BY ALL""")
def c5_band_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's spans by band and label."""
    rows = _model_spans(spark, sf_dir).withColumn("band", K.band(F.col("score"), F.col("label"), F.col("layer")))
    return rows.groupBy("band", "label").agg(F.count("*").alias("n"))


@query()
def u5_span_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any table ``(doc_id, start, end, label, score)`` as a model: its spans merged with the rules' and banded."""
    model = _model_spans(spark, sf_dir).select(F.col("source_ord").alias("doc_id"), "start", "end", "label", "score")
    merged = K.with_model(D.document_spans(probed(spark, sf_dir)), model)
    return merged.groupBy("doc_id", "layer", "band").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query("""WITH s AS (SELECT user_id AS scope, event_type AS type, props AS value, CASE WHEN value >= 60 THEN 'certain' ELSE 'uncertain' END AS band FROM events)
SELECT scope, type, count(*) AS n, count(*) FILTER (WHERE c) AS certain FROM (SELECT *, bool_or(band = 'certain') OVER (PARTITION BY scope, type, value) AS c FROM s) GROUP BY scope, type""")
def c6_propagate_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as scores: one certain use of a value makes all its uses certain for that user."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("type"), F.col("props").alias("value"), F.when(F.col("value") >= 60, "certain").otherwise("uncertain").alias("band"))
    return K.propagate_certain(rows).groupBy("scope", "type").agg(F.count("*").alias("n"), F.sum(F.col("certain").cast("long")).alias("certain"))


@query()
def c7_apply_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, _, _ = _decided(spark, sf_dir)
    return spans.groupBy("scope", "type", "decision").count()


@query()
def c8_uncertain_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, _, _ = _decided(spark, sf_dir)
    return K.uncertain_questions(spans)


def _rendered(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts with their spans as tokens, and the vault; the spans are found once, for both. Texts are dealt out by source."""
    spans = written(_spans(spark, sf_dir), "spans").withColumn("certain", F.lit(True))
    vault = K.mint_tokens(spans)
    decided = spans.join(vault.select("scope", "type", "value", "token"), ["scope", "type", "value"]).withColumn("decision", F.lit("replace"))
    sources = probed(spark, sf_dir, dealt=False).select(F.col("source").alias("scope"), F.col("doc_id").alias("source_ord"), "text")
    return K.render(sources.repartition("scope", "source_ord"), decided, keep=keep), vault


@query()
def c9_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir)[0].select("source_ord", F.md5("rendered").alias("digest"))


@query()
def c10_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, _, _ = _decided(spark, sf_dir)
    return K.decisions(spans).groupBy("scope", "label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def _label_vault(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels of a page's controls, and as its vault the words of its odd controls."""
    controls = A.parse_controls(table(spark, sf_dir, "pages")).where("label <> ''").withColumnRenamed("page_id", "scope")
    values = controls.where("ord % 2 = 1").select("scope", F.col("ord").cast("long").alias("source_ord"), F.lit(0).alias("start"), F.lit("LABEL").alias("type"), F.col("label").alias("value"))
    return controls, K.mint_tokens(values)


@query()
def c11_replace_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls, vault = _label_vault(spark, sf_dir)
    return K.replace_known_values(controls, vault).select("scope", "ord", "new_label")


@query()
def c12_replace_substring_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls, vault = _label_vault(spark, sf_dir)
    return K.replace_substring_values(controls, vault).select("scope", "ord", "new_label")


@query(f"WITH {PROBED} SELECT doc_id AS source_ord, false AS rejected, md5(text) AS digest FROM probed")
def c13_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rendered as tokens and restored."""
    rendered, vault = _rendered(spark, sf_dir)
    return K.rehydrate(rendered, vault, by=["source_ord"]).select("source_ord", "rejected", F.md5("restored").alias("digest"))


@query()
def c14_replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, vault, answers = _decided(spark, sf_dir)
    return K.replaced_rows(K.decisions(spans), answers, vault).groupBy("scope", "type", "layer").count()


@query(f"""{_EMAILS}, s AS (SELECT DISTINCT scope, value FROM vault), p AS (SELECT source AS scope, lower(text) AS t FROM probed)
SELECT scope, md5(value) AS value, CAST(sum((length(t) - length(replace(t, lower(value), ''))) / length(value)) AS BIGINT) AS n FROM s JOIN p USING (scope) GROUP BY scope, value""")
def c15_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a source against the texts of that source as they were: all leak."""
    values = K.mint_tokens(_spans(spark, sf_dir).where("type = 'EMAIL'")).select("scope", "value")
    bodies = probed(spark, sf_dir, dealt=False).select(F.col("source").alias("scope"), "doc_id", "text")
    return K.leak_check(bodies, values, "scope").select("scope", F.md5("value").alias("value"), "n")


@query("SELECT CAST(NULL AS BIGINT) AS source_ord, CAST(NULL AS VARCHAR) AS why WHERE false")
def c16_redaction_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text doesn't come back from its tokens, or still holds a span after rendering: none."""
    rendered, vault = _rendered(spark, sf_dir, keep=True)
    lost = ~F.col("restored").eqNullSafe(F.col("text"))
    blank = S.blanked(F.col("rendered"), r"[A-Z][A-Z0-9]*#[0-9]+")
    back = S.spread(K.rehydrate(rendered, vault, by=["source_ord"]), "source_ord", items=F.array(F.struct(lost.alias("lost"), blank.alias("blank"))), test="lost")  # texts go before the scan
    back = D.document_spans(back, "blank")
    why = F.array(F.when(F.col("lost"), "not restored"), F.when(F.size("spans") > 0, "span left"))
    return S.spread(back, "source_ord", items=F.transform(why, lambda w: F.struct(w.alias("why"))), test="why")


@query(f"""WITH {BOXES} SELECT image, CAST(floor(box_id / 10) AS BIGINT) AS control, kind, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
 CASE WHEN max(confidence) >= 0.98 THEN 'high' ELSE 'low' END AS confidence FROM boxes GROUP BY 1, 2, 3""")
def c17_mask_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mask_boxes(boxes(spark, sf_dir).withColumn("control", (F.col("box_id") / 10).cast("long")), "image", "control")
