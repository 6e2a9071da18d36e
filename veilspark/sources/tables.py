"""Sources with contracts, and sinks that never overwrite evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None, rows: int | None = None) -> DataFrame:
    """A frozen table. A schema other than the one agreed, or another number of rows, is an error before any use."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if schema is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"{name}: its columns are {df.schema.simpleString()}, not {schema.simpleString()}")
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{name}: it has {found} rows, not {rows}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, bad: str = "_bad") -> DataFrame:
    """JSON lines by an explicit schema; a line that doesn't parse has its text in ``bad``."""
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def parse_jsonl(lines: DataFrame, column: str, schema: T.StructType, bad: str = "_bad") -> DataFrame:
    """The same of lines that are already rows."""
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    got = F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    return lines.withColumn("_got", got).select(*(c for c in lines.columns if c != column), "_got.*")


def read_csv_contract(spark: SparkSession, path: str, required: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A CSV with a header: every cell trimmed, empty for none; and the required columns that it lacks."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns)), [c for c in required if c not in df.columns]


def parse_annotations(df: DataFrame, column: str, element: T.DataType) -> DataFrame:
    """A JSON string column as rows with their place; a row without any keeps one row of nulls."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode_outer(F.from_json(column, T.ArrayType(element))).alias("ordinal", "item"))


def write_once(df: DataFrame, path: str) -> None:
    """Write Parquet, refusing a path that exists."""
    df.write.mode("errorifexists").parquet(path)


def with_split_ids(df: DataFrame, split: str, order: str, buckets: int = 64) -> DataFrame:
    """Dense ids ``split-00000`` in the order of ``order`` within each split, without one task numbering a whole split.

    Rows are numbered within buckets by ranges of a digest of the key; the buckets' sizes, a small table, give offsets.
    """
    digest = F.sha2(F.col(order).cast("string"), 256)
    held = df.withColumn("_key", digest).withColumn("_bucket", F.conv(F.substring("_key", 1, 2), 16, 10).cast("int") * buckets / 256)
    held = held.withColumn("_bucket", F.floor("_bucket"))
    sizes = held.groupBy(split, "_bucket").count()
    offset = sizes.withColumn("_off", F.sum("count").over(Window.partitionBy(split).orderBy("_bucket")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy(split, "_bucket").orderBy("_key", order))
    numbered = held.withColumn("_n", within).join(offset, [split, "_bucket"])
    number = (F.col("_off") + F.col("_n") - 1).cast("string")
    name = F.concat_ws("-", split, F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number))
    return numbered.select(*df.columns, name.alias("split_id"))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.partitionBy(split).mode("errorifexists").parquet(path)


def latest(audit: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The view of the latest ``n`` rows that retention keeps."""
    return audit.orderBy(F.desc(at), F.desc(key)).limit(n)


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The five named entities, the ampersand last."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def squeezed(text: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))




def page_text(html: Column) -> Column:
    """The visible text of a page: no comments, no scripts or styles, tags as spaces, entities decoded."""
    for tag in ("script", "style", "noscript", "template"):
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return squeezed(decoded(F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")))


def attribute(tag: Column, name: str) -> Column:
    """A double-quoted attribute of a tag, null if it has none."""
    found = F.regexp_extract(tag, rf'(?i)[ \t\n]{name}="([^"]*)"', 1)
    return F.when(found != "", decoded(found))


CONTROL = r"(?is)<a[ >][^>]*>.*?</a>|<a>.*?</a>|<button[^>]*>.*?</button>|<input[^>]*>|<select[^>]*>|<textarea[^>]*>"
CONTROL_LIMIT = 180


def parse_controls(pages: DataFrame, limit: int = CONTROL_LIMIT) -> DataFrame:
    """One row per control of a page, in order: tag, type, label, href, and a selector that is unique on the page.

    ``limit`` is the page contract's number of controls, as in the scan that this table stands for.
    """
    raw = F.slice(F.regexp_extract_all("html", F.lit(CONTROL), F.lit(0)), 1, limit)
    rows = pages.select("page_id", F.posexplode(raw).alias("ord", "raw"))
    head = F.regexp_extract("raw", r"(?is)^<[^>]*>", 0)
    text = F.nullif(squeezed(decoded(F.regexp_replace(F.regexp_replace("raw", r"(?is)^<[^>]*>", ""), "<[^>]*>", " "))), F.lit(""))
    tag = F.lower(F.regexp_extract("raw", "(?i)^<([a-z]+)", 1))
    label = F.coalesce(attribute(head, "aria-label"), text, attribute(head, "placeholder"), attribute(head, "name"), attribute(head, "title"), F.lit(""))
    kind = F.when(tag == "a", "link").when(tag == "input", F.coalesce(F.lower(attribute(head, "type")), F.lit("text"))).otherwise(tag)
    return rows.select("page_id", "ord", tag.alias("tag"), kind.alias("type"), label.alias("label"), attribute(head, "href").alias("href"), F.concat(F.lit("#c"), "ord").alias("selector"))


def status_text(html: Column) -> Column:
    """The first five distinct texts (at most 200 characters) that a page announces."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<([a-z0-9]+)[^>]*(?:role="(?:status|alert)"|aria-live="[^"]*")[^>]*>(.*?)</\1>'), F.lit(2))
    found = F.concat(found, F.regexp_extract_all(html, F.lit(r"(?is)<output[^>]*>(.*?)</output>"), F.lit(1)))
    clean = F.transform(found, lambda x: F.substring(squeezed(decoded(F.regexp_replace(x, "<[^>]*>", " "))), 1, 200))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: x != "")), 1, 5)
