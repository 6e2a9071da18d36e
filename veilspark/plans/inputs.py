"""Inputs that the operators' queries derive from the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts whose rows are worked on for long, dealt out anew: a row group is read by one task, and it may be a
    whole table."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(cores, size // BLOCK_BYTES))


def probed(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Documents, each followed by a line with personal data of the kinds that their texts lack, made from the id; not
    ``dealt`` out anew for what deals them out itself."""
    n = lambda width, mod, off=0: F.lpad(((F.col("doc_id") + off) % mod).cast("string"), width, "0")
    line = F.concat(
        F.lit("\nPAN ABCDE"), n(4, 10000), F.lit("F passport K"), n(7, 10000000), F.lit(" aadhaar "), n(4, 10000), F.lit(" "), n(4, 10000, 7), F.lit(" "), n(4, 10000, 13),
        F.lit(" uid "), n(12, 1000000000000), F.lit(" call +91 9"), n(9, 1000000000), F.lit(" or 98765 4"), n(4, 10000), F.lit(" or +44 20 79"), n(2, 100), F.lit(" "), n(4, 10000),
        F.lit(" mail user"), F.col("doc_id").cast("string"), F.lit("@example.test otp is "), n(6, 1000000), F.lit(" password: s3cret"), F.col("doc_id").cast("string"), F.lit(" cvv 1"), n(2, 100), F.lit(" end"),
    )
    docs = texts(spark, sf_dir) if dealt else table(spark, sf_dir, "documents")
    return docs.withColumn("text", F.concat("text", line))


def _n(width: int, mod: int, off: int = 0) -> str:
    return f"lpad(CAST((doc_id + {off}) % {mod} AS VARCHAR), {width}, '0')"


PROBED = f"""probed AS (SELECT doc_id, lang, source, n_chars, text || chr(10) || 'PAN ABCDE' || {_n(4, 10000)} || 'F passport K' || {_n(7, 10000000)} || ' aadhaar '
 || {_n(4, 10000)} || ' ' || {_n(4, 10000, 7)} || ' ' || {_n(4, 10000, 13)} || ' uid ' || {_n(12, 1000000000000)} || ' call +91 9' || {_n(9, 1000000000)} || ' or 98765 4' || {_n(4, 10000)}
 || ' or +44 20 79' || {_n(2, 100)} || ' ' || {_n(4, 10000)} || ' mail user' || CAST(doc_id AS VARCHAR) || '@example.test otp is ' || {_n(6, 1000000)} || ' password: s3cret'
 || CAST(doc_id AS VARCHAR) || ' cvv 1' || {_n(2, 100)} || ' end' AS text FROM documents)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as rows of a reviewer's predictions: probabilities, choices and truths by arithmetic on them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d, n = F.col("doc_id"), F.col("n_chars")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", "n_chars",
        ((n % 101) / 100.0).cast("double").alias("p_nav"),
        ((n * 7 % 101) / 100.0).cast("double").alias("p_destr"),
        ((n * 13 % 101) / 100.0).cast("double").alias("p_off"),
        ((d * 17 % 100) / 100.0).cast("double").alias("confidence"),
        ((d % 20) / 20.0).cast("double").alias("free_p"),
        (d % 3 == 0).alias("unseen"),
        (d % 5 == 0).alias("free_text"),
        F.element_at(F.array(*map(F.lit, ("navigational", "state-changing", "destructive"))), (d % 3 + 1).cast("int")).alias("gold"),
        F.element_at(F.array(*map(F.lit, ("navigational", "state-changing", "destructive"))), (n % 3 + 1).cast("int")).alias("said"),
        F.when(d % 7 == 0, "destructive").otherwise("state-changing").alias("regex_tier"),
    )


PREDICTIONS = """predictions AS (SELECT doc_id, lang, source, quality, toxic, n_chars, (n_chars % 101) / 100.0::DOUBLE AS p_nav, (n_chars * 7 % 101) / 100.0::DOUBLE AS p_destr,
 (n_chars * 13 % 101) / 100.0::DOUBLE AS p_off, (doc_id * 17 % 100) / 100.0::DOUBLE AS confidence, (doc_id % 20) / 20.0::DOUBLE AS free_p, doc_id % 3 = 0 AS unseen, doc_id % 5 = 0 AS free_text,
 (['navigational', 'state-changing', 'destructive'])[doc_id % 3 + 1] AS gold, (['navigational', 'state-changing', 'destructive'])[n_chars % 3 + 1] AS said,
 CASE WHEN doc_id % 7 = 0 THEN 'destructive' ELSE 'state-changing' END AS regex_tier FROM documents JOIN labels USING (doc_id))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on images of 1000 x 800: odd lines are truth, even ones predictions. Lines' numbers repeat within
    an order, so ids hold more of a line."""
    x, y = (F.col("l_partkey") * 37 % 900).cast("double"), (F.col("l_suppkey") * 53 % 700).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 1000).alias("box_id"),
        (F.col("l_orderkey") / 8).cast("long").alias("image"),
        F.when(F.col("l_linenumber") % 2 == 1, "truth").otherwise("pred").alias("side"),
        F.when(F.col("l_partkey") % 2 == 0, "email").otherwise("face").alias("kind"),
        x.alias("x"), y.alias("y"), (F.col("l_quantity") * 4 + 20).alias("w"), (F.col("l_quantity") * 3 + 15).alias("h"), (1 - F.col("l_discount")).alias("confidence"),
    )


BOXES = """boxes AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000 + (l_partkey * 7 + l_suppkey * 3) % 1000 AS box_id, CAST(floor(l_orderkey / 8) AS BIGINT) AS image, CASE WHEN l_linenumber % 2 = 1 THEN 'truth' ELSE 'pred' END AS side,
 CASE WHEN l_partkey % 2 = 0 THEN 'email' ELSE 'face' END AS kind, CAST(l_partkey * 37 % 900 AS DOUBLE) AS x, CAST(l_suppkey * 53 % 700 AS DOUBLE) AS y, l_quantity * 4 + 20 AS w,
 l_quantity * 3 + 15 AS h, 1 - l_discount AS confidence FROM lineitem)"""

LANES = ("L0_strip_local", "L1_plan_validate", "L2_full_core")
STAGES = ("perceive", "redact", "plan", "check", "gate", "act", "total")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stage clocks of attempts: seven events of a user are one attempt's stages; some are missing."""
    e = table(spark, sf_dir, "events")
    lane = F.element_at(F.array(*map(F.lit, LANES)), (F.col("user_id") % 3 + 1).cast("int"))
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(
        (F.col("event_id") / 7).cast("long").alias("attempt_id"), lane.alias("user_lane"), stage.alias("stage"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("ms"), F.col("user_id"), F.col("ts"), F.col("event_id"),
        F.element_at(F.array(*map(F.lit, LANES)), ((F.col("event_id") / 7).cast("long") % 3 + 1).cast("int")).alias("lane"),
    )


ATTEMPTS = f"""attempts AS (SELECT CAST(floor(event_id / 7) AS BIGINT) AS attempt_id, ({list(LANES)})[user_id % 3 + 1] AS user_lane, ({list(STAGES)})[event_id % 7 + 1] AS stage,
 CASE WHEN event_id % 97 <> 0 THEN value END AS ms, user_id, ts, event_id, ({list(LANES)})[CAST(floor(event_id / 7) AS BIGINT) % 3 + 1] AS lane FROM events)"""
