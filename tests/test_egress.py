"""The first field of a body in which a pass finds anything, where it holds few spans, many, or nothing at all."""

from pyspark.sql import functions as F

from veilspark.operators import detection as D

BODIES = [
    (1, [("a", "ask EMAIL#12"), ("b", "to u@x.com"), ("c", "v@y.com")]),
    (2, [("a", None), ("b", "")]),
    (3, [("a", "9876543210 " * 70), ("b", "u@x.com")]),
    (4, [("b", "call 98765 4PHONE#13210"), ("a", "u@x.com")]),
    (5, []),
    (6, None),
]


def test_egress_guard(spark):
    bodies = spark.createDataFrame(BODIES, "k int, e array<struct<key:string,value:string>>").select("k", F.map_from_entries("e").alias("leaves"))
    got = {r.k: (r.pattern, r.field) for r in D.egress_guard(bodies, ["k"], "leaves").collect()}
    assert got == {1: ("email", "b"), 3: ("phone", "a"), 4: ("email", "a")}
