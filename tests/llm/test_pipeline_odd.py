"""The stages on odd rows: repeats, nulls, clashing columns, very long texts."""

import corpus_pipeline as C
from veilspark.llm import common


def test_stages_take_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp int, m_source string, row long, lang_pred string, claim string"
    texts = ["the cat sat on the mat and the hat", "le chien est dans la maison rouge", "der hund ist in dem alten haus"]
    rows = [(i, f"{texts[i % 3]} {'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10] * 2} number", ("en", "fr", "de")[i % 3], f"s{i % 4}", 1, i, "x", i, "zz", None) for i in range(90)]
    rows += [rows[0], rows[0], (None, texts[0] + " nobody", "en", None, None, None, None, None, None, None), (500, None, None, None, None, None, None, None, None, None), (501, "", "en", "s1", 0, 1, "y", 2, "c", "d")]
    rows += [(502, "the cat and the mat were on the hat " * 40_000, "en", "s1", 7, 7, "q", 7, "e", "f"), (503, "12 34", "en", "s1", 7, 7, "q", 7, "e", "f")]
    docs = spark.createDataFrame(rows, schema)
    seen = {}
    for name, stage in C.STAGES:
        out = common.materialize(stage(spark, docs, sf), name)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        seen[name] = ids
        assert out.columns[: len(docs.columns)] == docs.columns or name == "shards"
        docs = out
    assert {500, 501, 503}.isdisjoint(seen["language"]) and {None, 502} <= set(seen["language"]) and seen["language"].count(0) == 3
    assert seen["near_duplicates"].count(0) == 1 and len(seen["near_duplicates"]) == len(set(seen["near_duplicates"]))
    assert set(seen["contamination"]) == set(seen["near_duplicates"])
    assert set(seen["mixture"]) <= set(seen["contamination"]) and sorted(map(str, seen["shards"])) == sorted(map(str, seen["mixture"]))
