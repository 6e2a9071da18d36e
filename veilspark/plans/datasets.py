"""Queries of dataset building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as G
from .gates import OPTIONS, options
from .inputs import PREDICTIONS, predictions, table
from .registry import query

_SHARE = "('0x' || substr(sha256('{0}:' || {1}), 1, 2))::INT / 256.0"
_SPLIT = f"s AS (SELECT *, CASE WHEN {_SHARE.format('task', 'doc_id')} < 0.3 THEN 'test' ELSE 'train' END AS split FROM documents)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stable_split(table(spark, sf_dir, "documents"), "doc_id", "task")


@query(f"WITH {_SPLIT} SELECT doc_id, split FROM s")
def g1_stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "split")


@query("SELECT source, count(*) AS n, source IN ('src3', 'src7') AS held FROM documents GROUP BY source")
def g2_group_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.where(F.col("source").isin("src3", "src7")).select("source").distinct()
    test, train = G.group_holdout(docs, "source", held)
    both = test.withColumn("held", F.lit(True)).unionByName(train.withColumn("held", F.lit(False)))
    return both.groupBy("source", "held").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def g3_dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dedupe_rows(table(spark, sf_dir, "documents"), ("text", "lang"), "doc_id").select("doc_id")


_GOALS = "c AS (SELECT item_id AS label, [item_id % 5, (item_id + 2) % 7] AS goals FROM benchmark), t AS (SELECT doc_id AS task, doc_id % 5 AS goal FROM documents)"


@query(f"""WITH {_GOALS}, n AS (SELECT g AS goal, count(DISTINCT label) AS n FROM (SELECT label, unnest(goals) AS g FROM c) GROUP BY g),
pos AS (SELECT DISTINCT task, goal, label FROM t JOIN (SELECT label, unnest(goals) AS g FROM c) ON g = goal),
others AS (SELECT goal, label, row_number() OVER (PARTITION BY goal ORDER BY sha256('7:' || goal || ':' || label), label) - 1 AS i, count(*) OVER (PARTITION BY goal) AS size FROM (SELECT DISTINCT goal FROM t), c WHERE NOT list_contains(goals, goal)),
neg AS (SELECT task, goal, label FROM t JOIN others USING (goal) LEFT JOIN n USING (goal) WHERE (i - ('0x' || substr(sha256('7:' || task), 1, 8))::BIGINT % size + size) % size < greatest(2, CAST(floor(coalesce(n, 0) * 1.5) AS BIGINT)))
SELECT task, goal, label, 'A' AS gold FROM pos UNION ALL SELECT task, goal, label, 'B' FROM neg""")
def g4_pair_positive_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks of five goals, benchmark items as controls that serve two goals each."""
    i = F.col("item_id")
    controls = table(spark, sf_dir, "benchmark").select(i.alias("label"), F.array(i % 5, (i + 2) % 7).alias("goals"))
    tasks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task"), (F.col("doc_id") % 5).alias("goal"))
    return G.pair_positive_negative(tasks, controls, "task", "goal", "label", "goals", "7")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) <= floor(count(*) OVER (PARTITION BY source) / 8) AS calib FROM documents")
def g5_calib_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.calib_carve(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source").select("doc_id", "calib")


_FIRST = "split_part(text, chr(10), 1)"


@query(f"""WITH {_SPLIT}, p AS (SELECT doc_id, split, {_FIRST} AS head, split_part(text, chr(10), -1) AS tail FROM s), seen AS (SELECT head AS x FROM p WHERE split = 'train' UNION SELECT tail FROM p WHERE split = 'train')
SELECT doc_id FROM p WHERE split = 'test' AND (head IN (SELECT x FROM seen) OR tail IN (SELECT x FROM seen))""")
def g6_split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test documents whose first or last line training has as a first or last line."""
    p = _split(spark, sf_dir).select("doc_id", "split", F.substring_index("text", "\n", 1).alias("head"), F.substring_index("text", "\n", -1).alias("tail"))
    return G.split_leak(p.where("split = 'train'"), p.where("split = 'test'"), ("head", "tail")).select("doc_id")


@query("SELECT md5(line) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents INTERSECT SELECT unnest(string_split(text, chr(10))) FROM benchmark)")
def g7_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", "\n")).alias("line"))
    return G.overlap_report(lines("documents"), lines("benchmark"), "line").select(F.md5("line").alias("line"))


@query(f"WITH {_SPLIT} SELECT v.doc_id FROM s v WHERE v.split = 'test' AND v.text NOT IN (SELECT text FROM s WHERE split = 'train')")
def g8_drop_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(spark, sf_dir)
    return G.drop_seen(s.where("split = 'test'"), s.where("split = 'train'"), ["text"]).select("doc_id")


@query("""WITH w AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 2 THEN 'both' WHEN i % 4 = 3 OR (n < 4 AND i = n - 1) THEN 'val' ELSE 'train' END AS part FROM w""")
def g9_bank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("bank"))
    return G.bank_split(docs, "bank", "doc_id").select("doc_id", "part")


@query(f"WITH {PREDICTIONS} SELECT lang, gold, unseen, count(*) AS n, CAST(grouping_id(lang, gold, unseen) AS BIGINT) AS level FROM predictions GROUP BY CUBE (lang, gold, unseen)")
def g10_split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.split_manifest(predictions(spark, sf_dir), "lang", "gold", "unseen")


@query(f"""WITH {OPTIONS}, a AS (SELECT page_id, action, n % 4 = 1 AS ok FROM options)
SELECT page_id, action, round(CASE WHEN ok THEN 0.98 / count(*) FILTER (WHERE ok) OVER (PARTITION BY page_id) ELSE 0.02 / greatest(1, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY page_id)) END, 9) AS target FROM a""")
def g11_soft_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = options(spark, sf_dir).withColumn("ok", F.col("n") % 4 == 1)
    return G.soft_targets(rows, "page_id", "ok").select("page_id", "action", F.round("target", 9).alias("target"))


def _blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as team-written rows, many of them broken in one way or another."""
    d = F.col("doc_id")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.when(d % 50 == 0, F.concat(F.lit("x"), d)).when(d % 40 == 1, F.lit("same")).otherwise(F.concat(F.lit("r"), d)).alias("id"), pick(("en", "hi", "fr"), d).alias("lang"), F.when(d % 17 == 0, " ").otherwise("do it").alias("task"), pick(("click", "type", "drag"), d / 3).alias("action"),
        F.lit("Go").alias("control_label"), pick(("button", "link", "input", "div"), d).alias("control_type"), pick(("", "EMAIL#1", "a@b.co"), d / 2).alias("value"), pick(("navigational", "destructive", ""), d / 5).alias("tier"), pick(("yes", "no", "maybe"), d / 7).alias("serves_task"), F.lit("").alias("notes"),
    )


_P = lambda names, by: f"({list(names)})[CAST(floor({by}) AS BIGINT) % {len(names)} + 1]"
BLIND = f"""blind AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'x' || doc_id WHEN doc_id % 40 = 1 THEN 'same' ELSE 'r' || doc_id END AS id, {_P(('en', 'hi', 'fr'), 'doc_id')} AS lang, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'do it' END AS task, {_P(('click', 'type', 'drag'), 'doc_id / 3')} AS action,
 'Go' AS control_label, {_P(('button', 'link', 'input', 'div'), 'doc_id')} AS control_type, {_P(('', 'EMAIL#1', 'a@b.co'), 'doc_id / 2')} AS value, {_P(('navigational', 'destructive', ''), 'doc_id / 5')} AS tier, {_P(('yes', 'no', 'maybe'), 'doc_id / 7')} AS serves_task FROM documents)"""
_BROKEN = {
    "example-row": "id LIKE 'x%'", "duplicate-id": "count(*) OVER (PARTITION BY id) > 1", "lang": "lang = 'fr'", "task-and-label": "task = ''", "action": "action = 'drag'", "control-type": "control_type = 'div'", "serves-task": "serves_task = 'maybe'",
    "click-tier": "action = 'click' AND tier = ''", "click-value": "action = 'click' AND value <> ''", "type-tier": "action = 'type' AND tier <> ''", "type-token": "action = 'type' AND value <> 'EMAIL#1'", "real-data": "value = 'a@b.co'",
}


@query(f"WITH {BLIND} SELECT id, rule FROM (SELECT id, unnest([{', '.join(f"CASE WHEN {t} THEN '{r}' END" for r, t in _BROKEN.items())}]) AS rule FROM blind) WHERE rule IS NOT NULL")
def g12_csv_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.csv_contract_check(_blind(spark, sf_dir))


QUOTAS = {"rows": 150, "hi": 40, "navigational": 30, "state-changing": 30, "destructive": 20, "serves_no": 40, "type": 15}


@query(f"""WITH {BLIND}, r AS (SELECT * FROM blind WHERE id NOT LIKE 'x%'), q AS (SELECT 'rows' AS quota, count(*) AS found, 150 AS wanted FROM r UNION ALL SELECT 'hi', count(*) FILTER (WHERE lang = 'hi'), 40 FROM r UNION ALL SELECT 'navigational', count(*) FILTER (WHERE tier = 'navigational'), 30 FROM r
 UNION ALL SELECT 'state-changing', count(*) FILTER (WHERE tier = 'state-changing'), 30 FROM r UNION ALL SELECT 'destructive', count(*) FILTER (WHERE tier = 'destructive'), 20 FROM r UNION ALL SELECT 'serves_no', count(*) FILTER (WHERE serves_task = 'no'), 40 FROM r UNION ALL SELECT 'type', count(*) FILTER (WHERE action = 'type'), 15 FROM r)
SELECT *, found >= wanted AS met FROM q""")
def g12_csv_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.csv_quotas(_blind(spark, sf_dir), QUOTAS)


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
SELECT doc_id, position, CASE WHEN position < 25 THEN 0 WHEN position < 120 THEN 1 ELSE 2 END AS slice FROM n WHERE position BETWEEN 5 AND 24 OR position BETWEEN 100 AND 119 OR position BETWEEN 150 AND 169""")
def g13_slice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.slice_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", (5, 100, 150), 20)


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}') AS digest FROM documents")
def g14_content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", G.content_fingerprint(docs, ("doc_id", "lang", "n_chars", "source")).alias("digest"))


@query("SELECT doc_id, sha256(lang || CASE WHEN doc_id % 100 = 3 THEN '!' ELSE '' END) AS digest, 'now' AS side FROM documents WHERE doc_id % 100 = 3 UNION ALL SELECT doc_id, sha256(lang), 'before' FROM documents WHERE doc_id % 100 = 3")
def g14_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.sha2(F.concat("lang", F.when(F.col("doc_id") % 100 == 3, "!").otherwise("")), 256).alias("digest"))
    return G.drift(now, docs.select("doc_id", F.sha2("lang", 256).alias("digest")), "doc_id")


@query("SELECT source, count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}'), 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS fingerprint FROM documents GROUP BY source")
def g14_dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dataset_fingerprint(table(spark, sf_dir, "documents"), ("doc_id", "lang", "n_chars", "source"), "source")


@query("SELECT page_id, length(html) || ':' || to_hex(CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(html, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT)).lower() AS digest FROM pages")
def g15_page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", G.page_digest(F.col("html")).alias("digest"))


@query("""WITH g AS (SELECT 'd' AS side, doc_id AS k, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents UNION ALL SELECT 'b', item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') FROM benchmark),
n AS (SELECT DISTINCT side, k, array_to_string(w[i + 1 : i + 8], ' ') AS gram FROM (SELECT side, k, w, unnest(range(0, len(w) - 7)) AS i FROM g WHERE len(w) >= 8))
SELECT d.k AS doc_id, b.k AS item_id, count(*) AS shared, round(count(*) / any_value(s.size), 6) AS ratio FROM n d JOIN n b ON d.gram = b.gram AND d.side = 'd' AND b.side = 'b'
JOIN (SELECT k, count(*) AS size FROM n WHERE side = 'b' GROUP BY k) s ON s.k = b.k GROUP BY d.k, b.k""")
def g16_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("ratio", F.round("ratio", 6))


