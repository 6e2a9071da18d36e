"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are counted by source, language and topic. Raking finds one factor per source, language and topic such that
the weighted tokens meet all three sets of target shares. The targets of languages and topics are two short lists given
by the caller (values off a list share the target of its last name), so their factors are two short vectors; a topic is a
column of the documents or, without one, a text's form. Sources may be any number, so their factors stay a table with one
row, holding at most languages x topics cells, for each source; their target weights are a table too, or a power of their
tokens. A sweep is two small aggregations over that table.

A document is kept with probability min(1, k x weight), k being set so that the expected tokens are ``budget`` times
all tokens. The draw is a digest of the document's id: the same wherever and however often it runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, uniform

LANGS = {"en": 0.40, "de": 0.20, "fr": 0.20, "es": 0.15, "other": 0.05}
TOPICS = {"table": 0.08, "code": 0.07, "contact": 0.05, "legal": 0.05, "prose": 0.75}
MARKS = {"table": (" | ",), "code": (" = ", "{"), "contact": ("@", "://"), "legal": ("icense", "opyright")}
SOURCE_POWER = 0.5
BUDGET = 0.5
SWEEPS = 20
STEPS = 12


def topic_of(text: Column) -> Column:
    """A document's form: the first topic of which its text holds a mark, else prose."""
    out = F
    for topic, marks in MARKS.items():
        out = out.when(reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in marks)), topic)
    return out.otherwise("prose")


def features(text: str = "text", lang: str = "lang", source: str = "source", topic: str | None = None, langs: dict[str, float] = LANGS, topics: dict[str, float] = TOPICS) -> dict[str, Column]:
    """Columns ``m_source``, ``m_lang``, ``m_topic`` (the last two as places in their lists) and ``m_tokens``."""
    place = lambda x, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), x), F.lit(0)), F.lit(len(names))).cast("int") - 1
    return {
        "m_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "m_lang": place(F.col(lang), langs),
        "m_topic": place(topic_of(F.col(text)) if topic is None else F.col(topic), topics),
        "m_tokens": F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
    }


def _shares(weights: dict[str, float], present: set[int]) -> list[float]:
    """Target shares by place, over the values that have any tokens."""
    total = sum(w for i, w in enumerate(weights.values()) if i in present)
    return [w / total if i in present else 0.0 for i, w in enumerate(weights.values())]


def _vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def rake(
    feats: DataFrame, source_power: float = SOURCE_POWER, budget: float = BUDGET, sweeps: int = SWEEPS, langs: dict[str, float] = LANGS, topics: dict[str, float] = TOPICS, sources: DataFrame | None = None
) -> tuple[DataFrame, Column, Column]:
    """From ``features``: the table ``(m_source, a)``, and two expressions of a row joined to it: weight, probability.

    The expected weighted tokens of each source, language and topic are the targets' shares of all tokens: sources'
    exactly, the others' up to the fit's remaining error. Documents without tokens have their cell's weight. Targets of
    values without tokens are left out and the rest scaled; ``sources(source, weight)`` gives sources' targets, of which
    one that it lacks has none: its documents have weight 0.
    """
    cells = feats.groupBy("m_source", "m_lang", "m_topic").agg(F.sum("m_tokens").alias("n")).where("n > 0")
    cell = F.struct(F.col("m_lang").alias("l"), F.col("m_topic").alias("t"), F.col("n").cast("double").alias("n"))
    table = cells.groupBy("m_source").agg(F.sum("n").cast("double").alias("n"), F.array_sort(F.collect_list(cell)).alias("cells"))
    if sources is None:
        table = table.withColumn("share", F.pow("n", F.lit(source_power)))
    else:
        given = sources.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("m_source")).agg(F.sum("weight").cast("double").alias("share"))
        table = table.join(given, "m_source", "left").withColumn("share", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)))
    table = materialize(table, "cells")
    total, share = table.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.sum("share")).first()
    if not total or not share:
        return table.select("m_source", F.lit(1.0).alias("a")), F.lit(1.0), F.lit(1.0)
    have = table.select(F.inline("cells")).agg(F.collect_set("l"), F.collect_set("t")).first()  # short fixed lists
    wanted_langs, wanted_topics = _shares(langs, set(have[0])), _shares(topics, set(have[1]))
    b, c = [1.0] * len(langs), [1.0] * len(topics)

    def mass(bs: list[float], cs: list[float]) -> Column:
        """A source's tokens under the two vectors of factors."""
        return F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["n"] * F.get(_vector(bs), x["l"]) * F.get(_vector(cs), x["t"]))

    def scaled(bs: list[float], cs: list[float]) -> DataFrame:
        return table.withColumn("a", F.col("share") / F.lit(share) * F.lit(total) / mass(bs, cs))

    def fitted(place: str, factor: Column, targets: list[float]) -> list[float]:
        """The factors that bring one list's sums to its targets, the others being as they are."""
        rows = scaled(b, c).select("a", F.inline("cells")).groupBy(place).agg(F.sum(F.col("a") * F.col("n") * factor).alias("s")).collect()
        sums = {r[place]: r.s for r in rows}
        return [t * total / sums[i] if sums.get(i) else 1.0 for i, t in enumerate(targets)]

    for _ in range(sweeps):
        b = fitted("l", F.get(_vector(c), F.col("t")), wanted_langs)
        c = fitted("t", F.get(_vector(b), F.col("l")), wanted_topics)
    factors = materialize(scaled(b, c), "factors")
    weight = lambda lang, topic: F.col("a") * F.get(_vector(b), lang) * F.get(_vector(c), topic)
    k = budget
    for _ in range(STEPS):
        spent = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["n"] * F.least(F.lit(1.0), F.lit(k) * weight(x["l"], x["t"])))
        k *= budget * total / factors.agg(F.sum(spent)).first()[0]
    w = weight(F.col("m_lang"), F.col("m_topic"))
    return factors.select("m_source", "a"), w, F.least(F.lit(1.0), F.lit(k) * w)


def sampled(docs: DataFrame, id_col: str = "doc_id", topic: str | None = None, langs: dict[str, float] = LANGS, topics: dict[str, float] = TOPICS, **options: float | DataFrame) -> DataFrame:
    """One row per input row: id, source, language, topic, tokens, weight, probability and whether it is kept.

    Null sources are one source (the empty name), null or unlisted languages and topics count as the last listed, null
    texts are prose without tokens; repeated rows share a decision. A cell without tokens has weight and probability by its factors,
    or 1 if its source has no tokens at all. A very long text is counted like any other, whole; columns of other names, also
    those that the operator uses inside, are left behind. An empty table gives an empty table.
    """
    feats = materialize(docs.select(F.col(id_col), *(v.alias(k) for k, v in features(topic=topic, langs=langs, topics=topics).items())), "features")
    table, w, p = rake(feats, langs=langs, topics=topics, **options)
    out = feats.join(table, "m_source", "left").withColumns({"w": F.coalesce(w, F.lit(1.0)), "p": F.coalesce(p, F.lit(1.0))})
    name = lambda names, at: F.get(F.array(*map(F.lit, names)), F.col(at))
    return out.select(
        id_col,
        F.col("m_source").alias("source"),
        name(langs, "m_lang").alias("lang"),
        name(topics, "m_topic").alias("topic"),
        F.col("m_tokens").alias("n_tokens"),
        F.round("w", 6).alias("weight"),
        F.round("p", 6).alias("probability"),
        (uniform(F.col(id_col), "mix:") < F.col("p")).alias("kept"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", topic: str | None = None, langs: dict[str, float] = LANGS, topics: dict[str, float] = TOPICS, **options: float | DataFrame) -> DataFrame:
    """The documents that ``sampled`` keeps, with their columns, whatever those are called."""
    names = docs.columns
    safe = {name: f"__veil_{i}" for i, name in enumerate(names)}
    feats = docs.toDF(*safe.values()).withColumns(features(safe["text"], safe["lang"], safe["source"], None if topic is None else safe[topic], langs, topics))
    table, _, p = rake(feats.select("m_source", "m_lang", "m_topic", "m_tokens"), langs=langs, topics=topics, **options)
    out = feats.join(table, "m_source", "left")
    kept = out.where(uniform(F.col(safe[id_col]), "mix:") < F.coalesce(p, F.lit(1.0)))
    return kept.select(*safe.values()).toDF(*names)


def sql(sweeps: int = SWEEPS) -> str:
    """The same in DuckDB SQL, every sweep written out."""
    lang = "CASE WHEN lang IN (" + ", ".join(f"'{x}'" for x in LANGS) + ") THEN lang ELSE 'other' END"
    topic = " ".join(f"WHEN {' OR '.join(f"contains(text, '{m}')" for m in ms)} THEN '{t}'" for t, ms in MARKS.items())
    rows = lambda d: ", ".join(f"('{k}', {v})" for k, v in d.items())
    parts = [
        f"""f AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, {lang} AS lang, CASE {topic} ELSE 'prose' END AS topic,
        CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM f GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "total AS MATERIALIZED (SELECT sum(n) AS n FROM cells)",
        f"""s AS MATERIALIZED (SELECT source, pow(sum(n), {SOURCE_POWER}) / (SELECT sum(x) FROM (SELECT pow(sum(n), {SOURCE_POWER}) AS x FROM cells GROUP BY source))
        * (SELECT n FROM total) AS goal FROM cells GROUP BY source)""",
        f"lt(lang, w) AS (VALUES {rows(LANGS)})",
        f"tt(topic, w) AS (VALUES {rows(TOPICS)})",
        "lg AS MATERIALIZED (SELECT lang, w / sum(w) OVER () * (SELECT n FROM total) AS goal FROM lt WHERE lang IN (SELECT lang FROM cells))",
        "tg AS MATERIALIZED (SELECT topic, w / sum(w) OVER () * (SELECT n FROM total) AS goal FROM tt WHERE topic IN (SELECT topic FROM cells))",
        "b0 AS (SELECT lang, 1.0 AS b FROM lg)",
        "c0 AS (SELECT topic, 1.0 AS c FROM tg)",
    ]
    a = "a{0}_{1} AS MATERIALIZED (SELECT source, goal / sum(n * b * c) AS a FROM cells JOIN s USING (source) JOIN b{0} USING (lang) JOIN c{1} USING (topic) GROUP BY source, goal)"
    for i in range(sweeps):
        parts += [
            a.format(i, i),
            f"b{i + 1} AS MATERIALIZED (SELECT lang, goal / sum(n * a * c) AS b FROM cells JOIN a{i}_{i} USING (source) JOIN c{i} USING (topic) JOIN lg USING (lang) GROUP BY lang, goal)",
            a.format(i + 1, i),
            f"c{i + 1} AS MATERIALIZED (SELECT topic, goal / sum(n * a * b) AS c FROM cells JOIN a{i + 1}_{i} USING (source) JOIN b{i + 1} USING (lang) JOIN tg USING (topic) GROUP BY topic, goal)",
        ]
    parts += [a.format(sweeps, sweeps), f"w AS MATERIALIZED (SELECT source, lang, topic, a * b * c AS w, coalesce(n, 0) AS n FROM a{sweeps}_{sweeps} CROSS JOIN b{sweeps} CROSS JOIN c{sweeps} LEFT JOIN cells USING (source, lang, topic))"]
    parts.append(f"k0 AS (SELECT CAST({BUDGET} AS DOUBLE) AS k)")
    parts += [f"k{i + 1} AS MATERIALIZED (SELECT k * {BUDGET} * (SELECT n FROM total) / (SELECT sum(n * least(1.0, k * w)) FROM w) AS k FROM k{i})" for i in range(STEPS)]
    return "WITH " + ",\n".join(parts) + f"""
    SELECT doc_id, f.source, f.lang, f.topic, f.n_tokens, round(coalesce(w, 1.0), 6) AS weight, round(coalesce(least(1.0, k * w), 1.0), 6) AS probability,
      CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(least(1.0, k * w), 1.0) AS kept
    FROM f LEFT JOIN w USING (source, lang, topic), k{STEPS}"""
