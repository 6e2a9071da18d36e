"""Many known values in many texts at once: automata with failure links over bounded blocks of a scope's values."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_VALUES, PART_CHARS, BATCH_FINDS = 50_000, 32 << 20, 10_000


def _scan(batches: Iterator[pa.RecordBatch], of_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order: a part's texts, which are held, each different one once, then the blocks of values to search them for;
    ``(key, kept, value, starts)`` of each find, ``kept`` the text itself if ``of_text``."""
    import ahocorasick

    own, held = None, {}
    for batch in batches:
        kind = pa.string() if of_text else batch.column(5).type
        out: list[list] = [[], [], [], []]

        def made(out: list[list] = out, key: pa.DataType = batch.column(0).type, kind: pa.DataType = kind) -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(out, (key, kind, pa.string(), pa.list_(pa.int32())), strict=True)]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "kept", "value", "starts"])

        for key, part, values, text, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True):
            if own != (key, part):
                own, held = (key, part), {}
            if text is not None:
                held.setdefault(text, []).append(text if of_text else kept.as_py())
                continue
            if not held:
                continue
            trie = ahocorasick.Automaton()
            for v in values.as_py():
                trie.add_word(v, v)
            trie.make_automaton()
            for text, rows in held.items():
                found: dict[str, list[int]] = {}
                for last, v in trie.iter(text):
                    found.setdefault(v, []).append(last + 1 - len(v))
                for v, starts in found.items():
                    for row in rows:
                        for column, x in zip(out, (key, row, v, starts), strict=True):
                            column.append(x)
                        if len(out[0]) >= BATCH_FINDS:
                            yield made()
        yield made()


def occurrences(texts: DataFrame, values: DataFrame, key: str, text: str = "text", value: str = "value", keep: Sequence[str] | None = None) -> DataFrame:
    """``(key, text, value, starts)``: where each value of a scope begins in each different text of that scope. With ``keep``,
    for each row of ``texts`` those of its columns stand in place of the text.

    A scope's texts are cut into parts of ``PART_CHARS`` on average, its values into blocks of ``BLOCK_VALUES``. A text is
    dealt out once, and every block to every part: values are far shorter than texts. So neither a scope with a large
    vault nor one with most texts is in one task, which holds one part and one block. Starts are code points, in order;
    finds overlap as they come. Null and empty texts and values have none, nor has a null scope.
    """
    whole = keep is None
    t = texts.where((F.length(text) > 0) & F.col(key).isNotNull())
    if whole:
        t = t.select(F.col(key), F.col(text)).distinct()
    v = values.where((F.length(value) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value")).distinct()
    # scopes of one part or block, which most are, aren't listed: the others are few
    parts = t.groupBy(F.col(key).alias("key")).agg((F.floor(F.sum(F.length(text)) / PART_CHARS) + 1).cast("int").alias("_parts")).where("_parts > 1")
    blocks = v.groupBy("key").agg((F.floor(F.count("*") / BLOCK_VALUES) + 1).cast("int").alias("_blocks")).where("_blocks > 1")
    place = lambda n, *x: F.pmod(F.xxhash64(*x), F.coalesce(n, F.lit(1))).cast("int")
    packed = v.join(F.broadcast(blocks), "key", "left").groupBy("key", place("_blocks", "value").alias("block")).agg(F.collect_list("value").alias("values"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    packed = packed.join(F.broadcast(parts), "key", "left").select("key", every.alias("part"), "block", "values")
    told_by = [c for c, kind in t.dtypes if "map<" not in kind and "variant" not in kind]  # copies of a text in other rows are other parts'
    kept = F.struct(*keep) if keep else F.lit(None).cast("boolean")
    dealt = t.join(F.broadcast(parts.withColumnRenamed("key", key)), key, "left").select(F.col(key).alias("key"), place("_parts", *told_by).alias("part"), F.lit(-1).alias("block"), F.col(text).alias("text"), kept.alias("kept"))
    both = packed.unionByName(dealt, allowMissingColumns=True).select("key", "part", "block", "values", "text", "kept")
    ordered = both.repartition("key", "part").sortWithinPartitions("key", "part", "block")
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("key", "kept")}
    found = ordered.mapInArrow(lambda batches: _scan(batches, whole), f"key {kinds['key']}, kept {'string' if whole else kinds['kept']}, value string, starts array<int>")
    return found.select(F.col("key").alias(key), *([F.col("kept").alias("text")] if whole else [F.col("kept")[c].alias(c) for c in keep]), "value", "starts")


def apart(starts, size):  # noqa: ANN001, ANN201
    """How many of a value's finds, in order, don't overlap the one counted before."""
    state = lambda end, n: F.struct(end.cast("int").alias("end"), n.cast("long").alias("n"))
    return F.aggregate(starts, state(F.lit(0), F.lit(0)), lambda a, s: F.when(s >= a["end"], state(s + size, a["n"] + 1)).otherwise(a), lambda a: a["n"])
