"""Queries of sources and of detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import spans as S
from ..operators import detection as D
from ..sources import tables as A
from ..streaming.streams import shared_folder
from .inputs import PROBED, probed, table, texts
from .registry import query

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def a1_load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema and the number of rows that were agreed are checked before the table is used."""
    agreed = table(spark, sf_dir, "events").count()
    return A.load_table(spark, sf_dir, "events", EVENTS, agreed).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT role, count(*) AS n, count(*) FILTER (WHERE turn % 50 = 7) AS rejected FROM (SELECT CASE WHEN turn % 50 = 7 THEN NULL ELSE role END AS role, turn FROM conversations) GROUP BY role")
def a2_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as JSON lines, some cut short, read by schema."""
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    lines = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 50 == 7, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    path = f"{shared_folder(spark)}/turns"
    lines.write.text(path)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return A.read_jsonl(spark, path, schema).groupBy("role").agg(F.count("*").alias("n"), F.count("_bad").alias("rejected"))


@query("""SELECT event_type, count(*) AS n, sum(event_id) AS ids, count(*) FILTER (WHERE event_id % 10 = 3) AS blanks, 'props,ts' AS missing FROM (SELECT event_id, event_type FROM events) GROUP BY event_type""")
def a3_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV with padded cells and some blank ones, read by contract; two required columns are missing."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("  "), "event_id").alias("event_id"), F.concat("event_type", F.lit("   ")).alias("event_type"), F.when(F.col("event_id") % 10 != 3, " x ").alias("note"))
    path = f"{shared_folder(spark)}/events"
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    cells, missing = A.read_csv_contract(spark, path, ["event_id", "event_type", "note", "props", "ts"])
    return cells.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids"), F.sum((F.col("note") == "").cast("long")).alias("blanks"), F.lit(",".join(missing)).alias("missing"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(0 AS INTEGER) AS ordinal FROM events GROUP BY k")
def a4_parse_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("items"))
    rows = A.parse_annotations(wrapped, "items", T.StructType([T.StructField("k", T.LongType())]))
    return rows.groupBy(F.col("item.k").alias("k"), "ordinal").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN ('0x' || substr(sha256('split:' || doc_id), 1, 2))::INT / 256.0 < 0.3 THEN 'test' ELSE 'train' END AS split, sha256(doc_id::VARCHAR) AS k FROM documents)
SELECT doc_id, split, split || '-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS split_id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY k, doc_id) - 1 AS n FROM s)""")
def a8_write_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    share = F.conv(F.substring(F.sha2(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 256), 1, 2), 16, 10).cast("int") / 256.0
    path = f"{shared_folder(spark)}/splits"
    A.write_splits(A.with_split_ids(docs.withColumn("split", F.when(share < 0.3, "test").otherwise("train")), "split", "doc_id"), path)
    return spark.read.schema("doc_id long, split_id string, split string").parquet(path)


_SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_DECODE = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def _squeeze(x: str) -> str:
    return _SQUEEZE.format(x)


def _decode(x: str) -> str:
    return _DECODE.format(x)


CONTROLS = f"""raw AS (SELECT page_id, unnest(list_slice(regexp_extract_all(html, '{A.CONTROL}'), 1, 180)) AS raw, unnest(range(0, least(180, len(regexp_extract_all(html, '{A.CONTROL}'))))) AS ord FROM pages),
heads AS (SELECT *, regexp_extract(raw, '(?is)^<[^>]*>') AS head, lower(regexp_extract(raw, '(?i)^<([a-z]+)', 1)) AS tag FROM raw),
controls AS (SELECT page_id, CAST(ord AS INTEGER) AS ord, tag, CASE WHEN tag = 'a' THEN 'link' WHEN tag = 'input' THEN coalesce(nullif(lower(regexp_extract(head, '(?i)[ \\t\\n]type="([^"]*)"', 1)), ''), 'text') ELSE tag END AS type,
 coalesce(nullif({_decode("regexp_extract(head, '(?i)[ \\t\\n]aria-label=\"([^\"]*)\"', 1)")}, ''), nullif({_squeeze(_decode("regexp_replace(regexp_replace(raw, '(?is)^<[^>]*>', ''), '<[^>]*>', ' ', 'g')"))}, ''),
  nullif(regexp_extract(head, '(?i)[ \\t\\n]placeholder="([^"]*)"', 1), ''), nullif(regexp_extract(head, '(?i)[ \\t\\n]name="([^"]*)"', 1), ''), nullif(regexp_extract(head, '(?i)[ \\t\\n]title="([^"]*)"', 1), ''), '') AS label,
 nullif({_decode("regexp_extract(head, '(?i)[ \\t\\n]href=\"([^\"]*)\"', 1)")}, '') AS href, '#c' || ord AS selector FROM heads)"""


@query(f"WITH {CONTROLS} SELECT * FROM controls")
def a9_parse_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parse_controls(table(spark, sf_dir, "pages"))


def _page_text() -> str:
    x = "html"
    for tag in ("script", "style", "noscript", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return _squeeze(_decode(f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"))


@query(f"SELECT page_id, md5({_page_text()}) AS digest, length({_page_text()}) AS n_chars FROM pages")
def a10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "pages").select("page_id", A.page_text(F.col("html")).alias("text"))
    return text.select("page_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT page_id, CAST(2 AS INTEGER) AS n, 'Saved ' || (page_id % 10) || '|Item & ' || page_id AS texts FROM pages")
def a11_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with announcements added, one of them twice."""
    note = F.concat(F.lit('<p role="status"> Saved  '), F.col("page_id") % 10, F.lit('</p><div aria-live="polite"><b>Item</b> &amp; '), F.col("page_id"), F.lit("</div><output>Saved "), F.col("page_id") % 10, F.lit("</output>"))
    texts = A.status_text(F.concat("html", note))
    return table(spark, sf_dir, "pages").select("page_id", F.size(texts).alias("n"), F.array_join(texts, "|").alias("texts"))


def _dd(x: str) -> str:
    return f"regexp_replace({x}, '([^0-9])', '\\1\\1', 'g')"


def _ww(x: str) -> str:
    return f"regexp_replace({x}, '([^A-Za-z0-9_])', '\\1\\1', 'g')"


def _found(body: str, words: bool = False) -> str:
    """All hits of a body between boundaries, in a text whose boundary characters are doubled."""
    outside = "[^A-Za-z0-9_]" if words else "[^0-9]"
    return f"regexp_extract_all({'wt' if words else 'dt'}, '(?:^|{outside})({body})(?:{outside}|$)', 1)"


_LUHN = """length(v) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(v), i, 1)::INT
 ELSE substr(reverse(v), i, 1)::INT * 2 - CASE WHEN substr(reverse(v), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_SEP = "(?:  |--)"
_BODIES = {
    "pan": _found("[A-Z]{5}[0-9]{4}[A-Z]", True),
    "passport": _found("[A-Za-z][0-9]{7}", True),
    "card": f"list_filter(list_transform({_found(f'[0-9](?:{_SEP}?[0-9]){{12,18}}')}, lambda x: regexp_replace(x, '[ -]', '', 'g')), lambda v: {_LUHN})",
    "aadhaar": _found(f"[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}}"),
    "phone5": _found(rf"\+\+91{_SEP}?[6-9][0-9]{{9}}"),
    "phone6": _found(f"[6-9][0-9]{{2}}{_SEP}[0-9]{{3}}{_SEP}[0-9]{{4}}"),
    "phone7": _found(f"[6-9][0-9]{{4}}{_SEP}[0-9]{{5}}"),
    "phone8": _found("[6-9][0-9]{9}"),
    "phone9": _found(rf"\+\+[1-9][0-9]{{1,3}}{_SEP}?[0-9]{{6,14}}"),
    "phone10": f"list_filter({_found(rf'\+\+[1-9][0-9]{{1,3}}(?:{_SEP}[0-9]{{2,4}}){{2,5}}')}, lambda x: length(regexp_replace(replace(x, '++', '+'), '[ -]', '', 'g')) >= 7)",
    "bare": f"CASE WHEN regexp_matches(text, '{P.AADHAAR_WORDS}') THEN {_found('[0-9]{12}')} ELSE [] END",
}
_TWICE = f"WITH {PROBED}, t AS (SELECT doc_id, lang, text, {_dd('text')} AS dt, {_ww('text')} AS wt FROM probed)"


@query(f"""{_TWICE} SELECT doc_id, len(regexp_extract_all(text, '{P.PASSES[0].regex}')) AS n_email, {', '.join(f'len({sql}) AS n_{name}' for name, sql in _BODIES.items())} FROM t""")
def b1_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each pass on whole documents, before any claim."""
    found = probed(spark, sf_dir).select("doc_id", S.candidates(F.col("text")).alias("spans"))
    names = ["email", "pan", "passport", "card", "aadhaar", *(f"phone{i}" for i in range(5, 11)), "bare"]
    count = lambda i: F.size(F.filter("spans", lambda s: s["pass"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{name}") for i, name in enumerate(names)))


@query(f"""{_TWICE} SELECT doc_id, len(c) AS n_cards, coalesce(md5(array_to_string(c, ',')), md5('')) AS cards FROM (SELECT doc_id, {_BODIES['card']} AS c FROM t)""")
def b2_luhn_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = F.transform(S.pattern_hits(F.col("text"), P.PASSES[3], 3), lambda s: F.regexp_replace(s["value"], "[ -]", ""))
    return probed(spark, sf_dir).select("doc_id", F.size(cards).cast("long").alias("n_cards"), F.md5(F.array_join(cards, ",")).alias("cards"))


@query(f"""{_TWICE} SELECT doc_id, len(c) AS n, md5(array_to_string(list_transform(c, lambda x: replace(replace(x, '  ', ' '), '++', '+')), ',')) AS phones FROM (SELECT doc_id, {_BODIES['phone10']} AS c FROM t)""")
def b3_intl_len_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = S.pattern_hits(F.col("text"), P.PASSES[10], 10)
    return probed(spark, sf_dir).select("doc_id", F.size(spans).cast("long").alias("n"), F.md5(F.array_join(F.transform(spans, lambda s: s["value"]), ",")).alias("phones"))


@query(f"""{_TWICE} SELECT lang, CAST(sum(len({_BODIES['bare']})) AS BIGINT) AS n, count(*) AS docs FROM t GROUP BY lang""")
def b4_aadhaar_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    spans = F.when(text.rlike(P.AADHAAR_WORDS), S.hits(text, P.AADHAAR_BARE)).otherwise(S.no_spans())
    return probed(spark, sf_dir).groupBy("lang").agg(F.sum(F.size(spans)).alias("n"), F.count("*").alias("docs"))


@query()
def b5_claim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed spans of whole documents, without their values."""
    spans = D.document_spans(probed(spark, sf_dir))
    return S.spread(spans, "doc_id", items=F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"])))




@query(f"""WITH {PROBED} SELECT doc_id, len(regexp_extract_all(text, '{P.LABELLED[12][2]}')) AS n_phone_like FROM probed""")
def b6_phone_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rule that needs no word boundary."""
    spans = S.hits(F.col("text"), P.LABELLED[12][2])
    return probed(spark, sf_dir).select("doc_id", F.size(spans).cast("long").alias("n_phone_like"))


@query()
def b6_labelled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.spread(probed(spark, sf_dir), "lang", items=S.labelled(F.col("text")))
    return rows.groupBy("lang", "kind", "rule").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query()
def b7_nearby_otp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = probed(spark, sf_dir).withColumn("found", S.labelled_and_codes(F.col("text")))
    codes = S.codes_of(F.col("found"))
    return docs.select("doc_id", F.size(codes).alias("n_open"), F.size(S.fresh_otp(codes, S.rules_of(F.col("found")))).alias("n_new"))


@query()
def b8_suppress_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.spread(D.sensitive_spans(probed(spark, sf_dir)), "lang", items="spans")
    return rows.groupBy("lang", "kind", "rule").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query()
def b9_sensitive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = S.kinds_of(F.col("spans"))
    return D.sensitive_spans(probed(spark, sf_dir)).select(F.array_join(kinds, ",").alias("kinds")).groupBy("kinds").count()


_HAS = {p.name: f"regexp_matches(text, $re${p.regex}$re$)" for p in P.SECRETS}


@query("SELECT doc_id, pattern, severity FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{p.name}' AS pattern, '{p.severity}' AS severity FROM documents WHERE {_HAS[p.name]} AND strlen(text) <= {P.SECRET_TEXT_LIMIT} AND source <> 'src19'" for p in P.SECRETS) + ")")
def b13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without values; texts of one source stand for the allowlist."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "doc_id"))
    return D.secret_scan(docs, ["^src19/"]).select("doc_id", "pattern", "severity")


@query("SELECT doc_id, CAST(i AS INTEGER) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE NOT (lang = 'de' AND source LIKE '%3') AND NOT (lang = 'fr' AND source = 'src7')) WHERE contains(lower(t), 'license') OR contains(lower(t), '@')")
def b14_forbidden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders by language and source, some of which are allowed."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".txt"))))
    return D.forbidden_lines(docs, ["LICENSE", "@"], allowed=("de/*3/*.txt", "**/fr/src7/"), path="path")


@query()
def b15_egress_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as bodies with three fields; a token is no hit, the digits around it may not join it."""
    turns = table(spark, sf_dir, "conversations")
    body = turns.select("conv_id", "turn", F.map_from_arrays(F.array(F.lit("task"), F.lit("dom"), F.lit("note")), F.array(F.concat(F.lit("ask EMAIL#"), "turn"), "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("call 98765 4"), F.lpad(F.col("conv_id").cast("string"), 4, "0"))).otherwise("")) ).alias("leaves"))
    return D.egress_guard(body, ["conv_id", "turn"], "leaves")


@query("""WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"url": null, "k": 1}' WHEN 1 THEN '{"scene": {"pixels": 1}}' WHEN 2 THEN props ELSE '{"email": "x"}' END AS body FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'field-5' WHEN 1 THEN 'scene-pixels' WHEN 3 THEN 'field-8' END AS rule FROM b""")
def b16_assert_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.lit('{"url": null, "k": 1}')).when(k == 1, F.lit('{"scene": {"pixels": 1}}')).when(k == 2, F.col("props")).otherwise(F.lit('{"email": "x"}'))
    return table(spark, sf_dir, "events").select("event_id", D.sanitized_rule(body).alias("rule"))


_WORDS = "regexp_extract_all(lower(label), '[a-z]+')"
_DESC = "[" + ", ".join(f"'{w}'" for w in P.DESCRIPTORS) + "]"


@query(f"WITH {CONTROLS} SELECT page_id, ord, len({_WORDS}) > 0 AND len(list_filter({_WORDS}, lambda w: NOT list_contains({_DESC}, w))) = 0 AS structural FROM controls")
def b17_descriptor_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = A.parse_controls(table(spark, sf_dir, "pages"))
    return controls.select("page_id", "ord", D.is_descriptor(F.col("label")).alias("structural"))


@query()
def b18_neutralise_scaffolding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls as numbered lines; every line keeps its length."""
    line = F.concat(F.col("ord").cast("string"), F.lit(". "), F.upper("tag"), F.lit(" type="), "type", F.lit(" selector="), "selector", F.lit(' label="'), "label", F.lit('"'))
    controls = A.parse_controls(table(spark, sf_dir, "pages")).withColumn("line", line)
    return controls.select("page_id", "ord", D.neutralised(F.col("line")).alias("neutral"), F.length("line").alias("n"))


@query()
def b19_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = D.chunk_lines(texts(spark, sf_dir))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("words").alias("most"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("""WITH t AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 158)) AS start FROM t WHERE n > 0)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(least(190, n - start) AS INTEGER) AS size FROM s WHERE start = 0 OR start + 32 < n""")
def b20_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    return D.token_windows(table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"))).select("doc_id", "start", F.size("window").alias("size"))


@query()
def b21_line_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document's lines, some turned into labels."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("x", "word"))
    words = words.withColumn("word", F.when(F.col("x") % 9 == 2, F.lit("Email:")).when(F.col("x") % 9 == 5, F.lit("other:")).otherwise(F.col("word")))
    return D.line_policy(words).groupBy("doc_id", "kind", "rule").count()


_CANON = "lower(trim(regexp_replace(regexp_replace(nfc_normalize(label), '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]', '', 'g'), '[ \\t\\n\\x0B\\f\\r_/.?=&+#:%-]+', ' ', 'g')))"


@query(f"WITH {CONTROLS} SELECT page_id, ord, {_CANON} AS canonical FROM controls")
def b22_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = A.parse_controls(table(spark, sf_dir, "pages"))
    return controls.select("page_id", "ord", D.canonical(F.col("label")).alias("canonical"))


_ODD = " ﬁle ①② Straße ＡＢ e\u0301t"  # a ligature, circled and full-width characters, a letter that folds into two, an accent apart


@query(f"""SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss') || ' file 12 strasse ab ét', '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)""")
def b23_norm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with words at its end that compatibility forms and case folding change."""
    w = D.norm_tokens(F.concat("text", F.lit(_ODD)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("SELECT event_id, CASE WHEN regexp_matches(v, '^(?:[A-Z][A-Z0-9]*#[0-9]+|[0-9]+)$') THEN v ELSE repeat('*', least(length(v), 18)) END AS masked FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'EMAIL#' || event_id ELSE event_id::VARCHAR END AS v FROM events)")
def b24_mask_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    value = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("EMAIL#"), "event_id")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", D.mask_value(value).alias("masked"))


@query("SELECT doc_id, CAST(line AS INTEGER) AS line, count(*) AS n, CAST(sum(least(800, x1) - x0) AS BIGINT) AS width FROM (SELECT doc_id, l AS line, i * 40 AS x0, i * 40 + 30 AS x1 FROM (SELECT doc_id, l, unnest(range(0, len(string_split(t, ' ')))) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS l FROM documents))) WHERE x0 < 800 GROUP BY doc_id, line")
def b25_word_text_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scans of one block: paragraphs of one line, words 30 wide and 40 apart, on images 800 wide."""
    word = lambda w, i: F.struct(w.alias("text"), F.lit(90.0).alias("confidence"), F.struct((i * 40).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (i * 40 + 30).cast("double").alias("x1"), F.lit(10.0).alias("y1")).alias("bbox"))
    line = lambda t: F.struct(F.array(F.struct(F.transform(F.split(t, " "), word).alias("words"))).alias("lines"))
    blocks = F.array(F.struct(F.transform(F.split("text", "\n"), line).alias("paragraphs")))
    scans = table(spark, sf_dir, "documents").select("doc_id", F.lit(800).alias("width"), F.lit(600).alias("height"), blocks.alias("blocks"))
    good, _ = D.flatten_words(scans, "doc_id")
    return good.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("width"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
p AS (SELECT vec_id, list_position(x, list_max(x)) AS best, 1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS c FROM s),
w AS (SELECT CAST(floor(vec_id / 3) AS BIGINT) AS word, (['O', 'B-NAME', 'I-NAME', 'B-EMAIL', 'I-EMAIL', 'B-CITY', 'O', 'B-PIN'])[(best - 1) % 8 + 1] AS label, c FROM p)
SELECT word, regexp_replace(arg_max(label, (c, label)), '^[BI]-', '') AS kind, round(max(c), 6) AS confidence FROM w WHERE label <> 'O' AND c >= 0.02 GROUP BY word""")
def b26_best_label_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a token's scores, eight labels dealt to their parts in turn; three tokens are a word."""
    vectors = table(spark, sf_dir, "embeddings")
    names = ["O", "B-NAME", "I-NAME", "B-EMAIL", "I-EMAIL", "B-CITY", "O", "B-PIN"]
    labels = [names[i % 8] for i in range(vectors.agg(F.max(F.size("embedding"))).first()[0] or 8)]
    logits = F.transform("embedding", lambda v: v.cast("double"))
    tokens = vectors.select((F.col("vec_id") / 3).cast("long").alias("word"), logits.alias("logits"))
    return D.best_label_per_word(tokens, labels, 0.02).withColumn("confidence", F.round("confidence", 6))


@query("SELECT conv_id, CAST(sum(strlen('{\"role\":\"' || role || '\",\"turn\":' || turn || '}')) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id")
def b27_json_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(D.json_bytes(F.struct("role", "turn"))).cast("long").alias("bytes"))
