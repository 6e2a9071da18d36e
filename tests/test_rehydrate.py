"""Texts restored from their own tokens, not from a scope's whole vault."""

from veilspark.operators import tokens as K


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rehydrate_looks_up_a_texts_own_tokens(spark):
    texts = spark.createDataFrame([("s", 1, "A#1 A#2"), ("s", 2, "A#1 A#2"), ("s", 3, "A#9"), ("t", 4, "A#1"), ("t", 5, None)], "scope string, ord int, rendered string")
    vault = spark.createDataFrame([("s", f"A#{i}", f"v{i}") for i in (1, 2, 3)], "scope string, token string, value string")
    back = K.rehydrate(texts, vault)
    got = {r["ord"]: (r["rejected"], r["restored"]) for r in back.collect()}
    assert got == {1: (False, "v1 v2"), 2: (False, "v1 v2"), 3: (True, None), 4: (True, None), 5: (None, None)}
    assert "_digest" in _plan(back)  # no map of a whole scope
