"""Splits, leak checks, fingerprints: dataset building over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def digest_share(key: Column, seed: str) -> Column:
    """The first byte of sha256(``seed:key``) over 256: the same for a key wherever it stands."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 2), 16, 10).cast("int") / 256.0


def stable_split(df: DataFrame, key: str, seed: str, share: float = 0.3) -> DataFrame:
    return df.withColumn("split", F.when(digest_share(F.col(key), seed) < share, "test").otherwise("train"))


def group_holdout(df: DataFrame, group: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the held groups, and all others."""
    return df.join(held, group, "left_semi"), df.join(held, group, "left_anti")


def dedupe_rows(df: DataFrame, parts: Sequence[str], order: str) -> DataFrame:
    """The first row, by ``order``, of each content of ``parts``."""
    key = F.sha2(F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}), 256)
    first = df.select(key.alias("_key"), F.col(order)).groupBy("_key").agg(F.min(order).alias(order))
    return df.withColumn("_key", key).join(first, ["_key", order], "left_semi").drop("_key")


def pair_positive_negative(tasks: DataFrame, controls: DataFrame, task: str, goal: str, label: str, goals: str, seed: str, factor: float = 1.5) -> DataFrame:
    """Each task with all controls that serve its goal, and with max(2, ``factor`` x as many) others, as far as there are.

    ``tasks(task, goal)``; ``controls(label, goals)``. A goal's others are numbered as rows, in a digest's order; a task
    takes those from a place of its own on, round the end: an equi-join on blocks of places, of which it needs a few, so
    no pair is made that isn't kept but for the rest of two blocks.
    """
    wanted = tasks.select(goal).distinct()
    labels = controls.select(label).distinct()
    pos = controls.select(label, F.explode(goals).alias(goal)).distinct().join(wanted, goal, "left_semi")
    n_pos = pos.groupBy(goal).agg(F.count("*").alias("_n_pos"))
    # every goal with every label but its own: the rows that are asked for, numbered
    part = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))
    spread = wanted.withColumn("_part", part).join(labels.withColumn("_part", F.pmod(F.xxhash64(label), F.lit(_PARTS)).cast("int")), "_part").drop("_part")
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(goal).cast("string"), F.col(label).cast("string")), 256)
    others = spread.join(pos, [goal, label], "left_anti").withColumn("_digest", digest)
    others = numbered(others, [goal], "_digest", [label]).select(goal, label, "_place", F.col("_size").alias("_n"))
    sizes = others.groupBy(goal).agg(F.first("_n").alias("_n")).join(n_pos, goal, "full").na.fill(0, ["_n", "_n_pos"])
    start = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(task).cast("string")), 256), 1, 8), 16, 10).cast("long"), F.greatest("_n", F.lit(1)))
    want = F.least(F.col("_n"), F.greatest(F.lit(2), F.floor(F.col("_n_pos") * factor)))
    asks = tasks.join(sizes, goal).withColumn("_start", start).withColumn("_end", F.col("_start") + want)
    blocks = lambda a, b: F.sequence(F.floor(a / _ROUND), F.floor((F.greatest(a, b) - 1) / _ROUND))
    once, again = blocks(F.col("_start"), F.least("_end", "_n")), F.when(F.col("_end") > F.col("_n"), blocks(F.lit(0), F.col("_end") - F.col("_n"))).otherwise(F.array().cast("array<bigint>"))
    asks = asks.withColumn("_block", F.explode(F.array_distinct(F.concat(once, again))))
    met = asks.join(others.drop("_n").withColumn("_block", F.floor(F.col("_place") / _ROUND)), [goal, "_block"])
    taken = F.col("_place").between(F.col("_start"), F.col("_end") - 1) | (F.col("_place") < F.col("_end") - F.col("_n"))
    neg = met.where(taken).select(task, goal, label, F.lit("B").alias("gold"))
    return tasks.select(task, goal).join(pos, goal).select(task, goal, label, F.lit("A").alias("gold")).unionByName(neg)


_PARTS, _ROUND = 64, 64


def calib_carve(df: DataFrame, key: str, bucket: str, part: int = 8) -> DataFrame:
    """``df`` plus ``calib``: exactly one row in ``part`` of each bucket, first by a digest of the key."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    held = df.withColumn("_digest", digest).withColumn("_head", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"))
    out = numbered(held, [bucket], "_head", ["_digest", key])
    return out.withColumn("calib", F.col("_place") < F.floor(F.col("_size") / part)).select(*df.columns, "calib")


def split_leak(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Test rows that reuse, in any of ``columns``, a phrase that training has in any of them."""
    seen = train.select(F.explode(F.array(*columns)).alias("phrase")).distinct()
    hit = [test.join(seen, F.col(c) == F.col("phrase"), "left_semi") for c in columns]
    out = hit[0]
    for h in hit[1:]:
        out = out.unionByName(h)
    return out.distinct()


def overlap_report(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that both sides have."""
    return a.select(column).intersect(b.select(column))


def drop_seen(val: DataFrame, train: DataFrame, body: Sequence[str]) -> DataFrame:
    """Rows of ``val`` whose body isn't in ``train``."""
    key = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256).alias("_key")
    return val.withColumn("_key", key).join(train.select(key).distinct(), "_key", "left_anti").drop("_key")


def bank_split(df: DataFrame, bank: str, order: str) -> DataFrame:
    """Every fourth entry of a bank, by ``order`` (a number), goes to val, as does the last of one with two or three; a
    single entry goes to both."""
    i, n = F.col("_place"), F.col("_size")
    val = F.when(n < 2, "both").when((i % 4 == 3) | ((n < 4) & (i == n - 1)), "val").otherwise("train")
    return numbered(df, [bank], order, []).withColumn("part", val).select(*df.columns, "part")


def split_manifest(df: DataFrame, *by: str) -> DataFrame:
    """Counts over every combination of ``by`` and all their totals; ``level`` says which."""
    return df.cube(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def soft_targets(options: DataFrame, step: str, accepted: str, wrong_mass: float = 0.02) -> DataFrame:
    """Each option's share: all but ``wrong_mass`` over the accepted ones, that over the rest."""
    w = Window.partitionBy(step)
    good = F.sum(F.col(accepted).cast("long")).over(w)
    bad = F.count("*").over(w) - good
    return options.withColumn("target", F.when(F.col(accepted), (1 - wrong_mass) / good).otherwise(wrong_mass / F.greatest(F.lit(1), bad)))


def slice_sample(df: DataFrame, key: str, offsets: Sequence[int], length: int) -> DataFrame:
    """``length`` consecutive rows, in the order of ``key``, from each of ``offsets``."""
    at = numbered(df, [], key, []).withColumnRenamed("_place", "position").drop("_size")
    which = F.coalesce(*(F.when(F.col("position").between(o, o + length - 1), i) for i, o in enumerate(offsets)))
    return at.withColumn("slice", which).where("slice IS NOT NULL")


def content_fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Rows and a digest of all of them that doesn't depend on their order, of the table or of each group: the sum of the
    rows' first 60 bits of SHA-256."""
    head = F.conv(F.substring(content_fingerprint(df, columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(head).cast("string").alias("fingerprint"))


def drift(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """``(key, digest)`` rows of either side that the other lacks."""
    return now.exceptAll(before).withColumn("side", F.lit("now")).unionByName(before.exceptAll(now).withColumn("side", F.lit("before")))


def page_digest(text: Column) -> Column:
    """``length:hash`` in hexadecimal, the hash being h x 31 + character over the text, modulo 2^32."""
    h = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % 4294967296)
    return F.concat_ws(":", F.length(text).cast("string"), F.lower(F.hex(h)))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc, item, shared, ratio)``: distinct n-grams of words that a document shares with an item, and their share of the
    item's, for pairs that share any.

    Hashes only find the places of documents that may be in an item: n-grams are equal by their words. Texts of fewer than
    ``n`` words share none.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "").alias("_w")
    gram = lambda i: F.array_join(F.slice("_w", i + 1, n), " ")

    def places(df: DataFrame, key: str, *more: Column) -> DataFrame:
        rows = df.select(key, words).select(key, "_w", F.posexplode("_w").alias("_at", "_")).where(F.col("_at") + n <= F.size("_w"))
        return rows.select(key, F.xxhash64(*(F.get("_w", F.col("_at") + i) for i in range(n))).alias("_digest"), *more)

    grams = places(benchmark, item, gram(F.col("_at")).alias("_gram")).distinct()
    sizes = grams.groupBy(item).agg(F.count("*").alias("_size"))
    found = places(docs, doc, F.col("_at")).join(grams.select("_digest").distinct(), "_digest", "left_semi")
    found = found.groupBy(F.col(doc).alias("_doc")).agg(F.collect_set("_at").alias("_places"))  # no more than a document's words
    # read at another text of the same id, places are n-grams of that id too
    held = docs.select(doc, text).join(found, F.col(doc).eqNullSafe(F.col("_doc"))).select(doc, words, "_places")
    held = held.select(doc, F.explode(F.transform(F.filter("_places", lambda i: i + n <= F.size("_w")), gram)).alias("_gram")).distinct()
    shared = held.join(grams.drop("_digest"), "_gram").groupBy(doc, item).agg(F.count("*").alias("shared"))
    return shared.join(sizes, item).select(doc, item, "shared", (F.col("shared") / F.col("_size")).alias("ratio"))


CSV_TIERS = ("navigational", "state-changing", "destructive")


def csv_contract_check(rows: DataFrame) -> DataFrame:
    """One row per broken rule of a team-written row ``(id, lang, task, action, control_label, control_type, value, tier, serves_task, notes)``."""
    c = {k: F.coalesce(F.trim(F.col(k)), F.lit("")) for k in ("id", "lang", "task", "action", "control_label", "control_type", "value", "tier", "serves_task", "notes")}
    every = F.concat_ws(" ", c["task"], c["control_label"], c["value"], c["notes"])
    repeated = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"), F.lit(True).alias("_dup"))
    rules = (
        ("example-row", F.startswith(c["id"], F.lit("x"))), ("duplicate-id", F.col("_dup")), ("lang", ~c["lang"].isin("en", "hi")), ("task-and-label", (c["task"] == "") | (c["control_label"] == "")), ("action", ~c["action"].isin("click", "type")),
        ("control-type", ~c["control_type"].isin("button", "link", "input")), ("serves-task", ~c["serves_task"].isin("yes", "no")), ("click-tier", (c["action"] == "click") & ~c["tier"].isin(*CSV_TIERS)), ("click-value", (c["action"] == "click") & (c["value"] != "")),
        ("type-tier", (c["action"] == "type") & (c["tier"] != "")), ("type-token", (c["action"] == "type") & ~c["value"].rlike("^[A-Z][A-Z0-9]*#[0-9]+")), ("real-data", every.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9]{10}")),
    )
    broken = F.array_compact(F.array(*(F.when(test, name) for name, test in rules)))
    checked = rows.join(repeated, F.col("id").eqNullSafe(F.col("_id")), "left")
    return checked.withColumn("_dup", F.coalesce("_dup", F.lit(False))).select("id", F.explode(broken).alias("rule"))


def csv_quotas(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Counts against quotas, template rows left out: ``(quota, found, wanted, met)``."""
    real = rows.where(~F.startswith("id", F.lit("x")))
    tests = {"rows": F.lit(True), "hi": F.col("lang") == "hi", "serves_no": F.col("serves_task") == "no", "type": F.col("action") == "type", **{t: F.col("tier") == t for t in CSV_TIERS}}
    counts = real.agg(*(F.coalesce(F.sum(F.coalesce(t, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, t in tests.items()))
    each = F.array(*(F.struct(F.lit(k).alias("quota"), F.col(f"`{k}`").alias("found"), F.lit(v).alias("wanted")) for k, v in quotas.items()))
    return counts.select(F.inline(each)).withColumn("met", F.col("found") >= F.col("wanted"))
