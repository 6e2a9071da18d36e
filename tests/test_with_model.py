"""A model's spans beside the rules': as layers merge, in long texts too, and from texts that are dealt out."""

import random
import time

from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.operators import tokens as K
from veilspark.plans import inputs, redaction

MODEL = "doc_id long, start int, end int, label string, score double"


def documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, at array<array<int>>")
    span = lambda x: F.struct(x[0].alias("start"), x[1].alias("end"), F.lit("pan").alias("kind"), F.lit("r").alias("rule"), F.lit("v").alias("value"), F.lit(0).alias("pass"))
    return docs.select("doc_id", "text", F.transform("at", span).alias("spans"))


def merged(docs, model):
    rules = S.spread(docs, "doc_id", items="spans").select("doc_id", "start", "end", F.upper("kind").alias("type"), "value", F.col("kind").alias("label"), F.lit(1.0).alias("score"))
    cut = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    said = docs.select("doc_id", "text").join(model, "doc_id").select("doc_id", "start", "end", F.upper(F.regexp_replace("label", "[^A-Za-z0-9]", "")).alias("type"), cut.alias("value"), "label", "score")
    return K.merge_layers(rules, said).withColumn("band", K.band(F.col("score"), F.col("label"), F.col("layer")))


def test_a_models_spans_are_merged_as_layers_are(spark):
    r = random.Random(7)
    odd = lambda n: None if r.random() < 0.03 else r.randint(-2, n)
    docs, model = [], []
    for d in range(120):
        n = r.choice([0, 1, 30, 200])
        rules = sorted([a, a + r.randint(0, 6)] for a in (r.randint(0, n) for _ in range(r.randint(0, 5))))
        docs.append((d, None if d % 40 == 3 else "".join(r.choice("aé😀 xZ") for _ in range(n)), None if d % 40 == 7 else rules))
        for _ in range(r.choice([0, 1, 5, 40])):
            a = odd(n)
            model.append((d, a, None if a is None or r.random() < 0.03 else a + r.randint(-1, 8), r.choice(["city", "person name", None, "x-1"]), r.choice([0.1, 0.2, 0.5, 0.9, None])))
    model += [(999, 1, 2, "city", 0.9), (None, 1, 2, "city", 0.9)]
    docs.append((None, "abc", [[0, 2]]))
    docs, model = documents(spark, docs), spark.createDataFrame(model, MODEL)
    key = lambda x: [(v is not None, v) for v in x]
    got, want = (sorted((tuple(x) for x in df.collect()), key=key) for df in (K.with_model(docs, model), merged(docs, model)))
    assert got == want and {x[7] for x in got} == {"regex", "model"} and len(got) > 300


def test_long_texts_are_not_read_again_for_each_span(spark):
    def seconds(n):
        docs = documents(spark, [(1, "é Abcdefg " * n, [[0, 1]])])
        model = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 10 + 2).cast("int").alias("start"), (F.col("id") * 10 + 9).cast("int").alias("end"), F.lit("city").alias("label"), F.lit(0.9).alias("score"))
        start = time.time()
        assert K.with_model(docs, model).where("value = 'Abcdefg' AND layer = 'model'").count() == n
        return time.time() - start

    seconds(100)
    assert seconds(60_000) < 12


def test_a_models_texts_are_dealt_out(spark, sf, monkeypatch):
    """A row group is read by one task."""
    monkeypatch.setattr(inputs, "BLOCK_BYTES", 1 << 10)
    assert redaction._model_spans(spark, sf).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
