"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become windows of ten normalised words (one shorter window for a shorter text), hashed and broadcast
in blocks of ``BLOCK`` windows, so that what is broadcast has a fixed bound however many benchmark texts there are
(one block, in practice). Each document is exploded to its word positions; the hash of the words from there on is
looked up, and a hit is verified word by word against the window. Only hits are gathered by document, so a passage
that very many documents share is never brought together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

WINDOW = 10
BLOCK = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words, in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _hash_at(hashes: str, at: str, length: int) -> Column:
    """Hash of ``length`` word hashes from position ``at``."""
    return F.xxhash64(F.lit(length), *(F.get(F.col(hashes), F.col(at) + i) for i in range(length)))


def _text_at(tokens: str, at: str, length: int) -> Column:
    return F.concat_ws(" ", *(F.get(F.col(tokens), F.col(at) + i) for i in range(length)))


def windows(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``(length, gram, items)``: distinct windows with the sorted, distinct ids (as strings) of the items they are in."""
    item = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    item = item.withColumn("length", F.least(F.size("w"), F.lit(size))).where("length > 0")
    at = item.select("item", "w", "length", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("at"))
    gram = at.select("item", "length", F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ").alias("gram"))
    return gram.groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _with_sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows carry the digest of their set of items; the sets are kept once each."""
    held = materialize(found.withColumn("set", F.sha2(F.to_json("items"), 256)), "windows")
    sets = held.groupBy("set").agg(F.first("items").alias("items"))
    return held.drop("items"), sets


def _marked(docs: DataFrame, block: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs(row, ..., w)`` exploded to one row at least for each document and one for each verified hit."""
    at = docs.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    at = at.select("row", "id", "w", "h", F.posexplode_outer("h").alias("at", "_"))
    length = F.col("length")
    if len(lengths) == 1:
        at = at.withColumn("length", F.lit(lengths[0])).withColumn("key", _hash_at("h", "at", lengths[0]))
    else:
        each = F.array(*(F.struct(F.lit(n).alias("length"), _hash_at("h", "at", n).alias("key")) for n in lengths))
        at = at.select("row", "id", "w", "h", "at", F.inline(each))
    at = at.withColumn("key", F.when(F.col("at") + length <= F.size("w"), F.col("key")))
    block = block.withColumn("w2", F.split("gram", " ")).withColumn("h2", F.transform("w2", lambda w: F.xxhash64(w)))
    pick = reduce(lambda out, n: out.when(length == n, F.xxhash64(F.lit(n), *(F.get("h2", F.lit(i)) for i in range(n)))), lengths, F)
    block = block.select(F.col("length").alias("length2"), pick.alias("key2"), "gram", "set")
    met = at.join(F.broadcast(block), F.col("key") == F.col("key2"), "left")
    text = reduce(lambda out, n: out.when(length == n, _text_at("w", "at", n)), lengths, F)
    hit = F.col("gram").isNotNull() & (length == F.col("length2")) & (text == F.col("gram"))
    met = met.where(F.coalesce("at", F.lit(0)).eqNullSafe(0) | F.col("gram").isNotNull())
    return met.select("row", "id", F.size("w").alias("n_words"), F.when(hit, F.struct("at", "length")).alias("hit"), F.when(hit, F.col("set")).alias("set"))


def _covered(hits: Column) -> Column:
    """Words under at least one of the ``(at, length)`` spans."""

    def add(seen, x):
        end = x["at"] + x["length"]
        new = F.greatest(F.lit(0), end - F.greatest(seen["end"], x["at"]))
        return F.struct((seen["n"] + new).alias("n"), F.greatest(seen["end"], end).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(F.array_distinct(hits)), zero, add, lambda x: x["n"].cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per input row: words, hit words, items hit, the digest of their ids, and whether any word is hit.

    Null texts have no words and no hits; benchmark texts that are null or hold no word are in no document; null item
    ids count as the empty string; repeated rows are reported each; a very long text is one row of words, searched whole;
    columns of other names are left behind. Empty tables give no rows, or no hits.
    """
    return _report(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text)).alias("w")), windows(benchmark, text=text, size=size)).withColumnRenamed("id", id_col)


def _report(docs: DataFrame, found: DataFrame) -> DataFrame:
    held, sets = _with_sets(found)
    stats = held.groupBy("length").agg(F.count("*").alias("n")).collect()  # ten lengths at most
    lengths, total = sorted(r["length"] for r in stats) or [WINDOW], sum(r.n for r in stats)
    blocks = max(1, -(-total // BLOCK))
    if blocks > 1:
        docs = materialize(docs, "rows")
        held = held.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(blocks)))
        parts = [held.where(F.col("part") == i).drop("part") for i in range(blocks)]
    else:
        parts = [held]
    marks = reduce(DataFrame.unionByName, (_marked(docs, part, lengths) for part in parts))
    per = marks.groupBy("row").agg(
        F.first("id").alias("id"), F.max("n_words").cast("long").alias("n_words"), _covered(F.collect_list("hit")).alias("n_hit"), F.collect_set("set").alias("sets")
    )
    per = materialize(per, "marks")
    ids = per.select("row", F.explode("sets").alias("set")).join(sets, "set").groupBy("row")
    ids = ids.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = per.drop("sets").join(ids, "row", "left")
    return out.select(
        "id",
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _content(text: Column) -> list[Column]:
    """What identifies a text: rows with the same one get the same verdict."""
    return [F.xxhash64(F.coalesce(text, F.lit(""))), F.crc32(F.coalesce(text, F.lit(""))), F.coalesce(F.octet_length(text), F.lit(0))]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a whole window of a benchmark text."""
    names = ["__veil_x", "__veil_c", "__veil_n"]
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*_content(F.col(text))).alias("id"), words(F.col(text)).alias("w"))
    bad = _report(keyed, windows(benchmark, size=size)).where("contaminated").select(*(F.col("id")[f"col{i}"].alias(n) for i, n in enumerate(names, 1))).distinct()
    held = docs.withColumns(dict(zip(names, _content(F.col(text)), strict=True)))
    return held.join(bad, names, "left_anti").select(*docs.columns)
