"""Detection jobs over whole tables, built of span columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions.text import composed, folded


def document_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``spans``: what the passes claim, by start. Candidates come first, in a projection of their own."""
    return docs.withColumn("candidates", S.candidates(F.col(text), alone=True)).withColumn("spans", S.claimed(F.col("candidates"))).drop("candidates")


def sensitive_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` plus the labelled spans that count. Each step is a column of its own, so none is computed twice."""
    found = F.col("_found")
    with_codes = docs.withColumn("_found", S.labelled_and_codes(F.col(text))).withColumn("_all", F.concat(S.rules_of(found), S.fresh_otp(S.codes_of(found), S.rules_of(found)))).drop("_found")
    return with_codes.withColumn(out, S.suppressed(F.col("_all"))).drop("_all")


def secret_scan(docs: DataFrame, allowed: Sequence[str] = (), text: str = "text", path: str = "path") -> DataFrame:
    """One row per text and pattern found in it; paths that match a pattern of ``allowed`` and huge texts are skipped."""
    scanned = docs.where(F.octet_length(text) <= P.SECRET_TEXT_LIMIT)
    if allowed:
        scanned = scanned.where(~F.coalesce(F.col(path).rlike("|".join(f"(?:{a})" for a in allowed)), F.lit(False)))
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p.regex), F.struct(F.lit(p.name).alias("pattern"), F.lit(p.severity).alias("severity"))) for p in P.SECRETS)))
    return S.spread(scanned, *(c for c in docs.columns if c != text), items=found, test="pattern")


def glob_regex(glob: str) -> str:
    """A path pattern as a regex: ``**/`` any folders, ``*`` within one, a closing ``/`` all below."""
    parts = {"**/": "(?:.*/)?", "*": "[^/]*"}
    body = "".join(parts.get(p) or re.escape(p) for p in re.findall(r"\*\*/|\*|[^*]+", glob))
    return f"^{body}" if glob.endswith("/") else f"^{body}$"


def forbidden_lines(docs: DataFrame, needles: Sequence[str], id_col: str = "doc_id", text: str = "text", allowed: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Numbers, from one, of the lines that hold any of ``needles`` in either case, but for paths that a glob allows."""
    if allowed:
        docs = docs.where(~S.any_of([F.col(path).rlike(glob_regex(g)) for g in allowed]))
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    hit = S.any_of([F.contains(F.lower("line"), F.lit(n.lower())) for n in needles])
    return lines.where(hit).select(id_col, (F.col("at") + 1).alias("line"))


def egress_guard(bodies: DataFrame, keys: Sequence[str], leaves: str) -> DataFrame:
    """The first field of each body, in order, in which a pass finds anything: its pattern and field, never the value."""
    rows = bodies.select(*keys, F.posexplode(F.map_entries(leaves)).alias("ord", "leaf"))
    open_ = rows.select(*keys, "ord", F.col("leaf.key").alias("field"), S.blanked(F.coalesce(F.col("leaf.value"), F.lit("")), P.VAULT_TOKEN).alias("_open"))
    hit = document_spans(open_, "_open").select(*keys, "ord", "field", F.get("spans", 0).alias("first")).where("first IS NOT NULL")
    return hit.groupBy(*keys).agg(F.min_by(F.struct(F.col("first.kind").alias("pattern"), "field"), "ord").alias("hit")).select(*keys, "hit.*")


def sanitized_rule(body: Column) -> Column:
    """The first rule that an outbound JSON body breaks, null if it may go out."""
    fields = [F.when(body.rlike(p), f"field-{i}") for i, p in enumerate(P.FORBIDDEN_FIELDS, 1)]
    broken = F.when(F.get_json_object(body, "$").isNull(), "not-json")
    pixels = [F.when(F.get_json_object(body, f"$.scene.{k}").isNotNull(), "scene-pixels") for k in ("pixels", "image", "bitmap")]
    return F.coalesce(*fields, broken, *pixels)


def is_descriptor(value: Column) -> Column:
    """Whether every word names a field, so that the value is a field's name and nobody's data."""
    words = F.regexp_extract_all(F.lower(value), F.lit("[a-z]+"), F.lit(0))
    known = F.array(*map(F.lit, P.DESCRIPTORS))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(known, w))


def neutralised(text: Column) -> Column:
    """Scaffolding of serialized controls replaced by filler of its own length: offsets stay."""
    return S.rebuilt(text, P.SCAFFOLDING, lambda v: F.when(v.isNotNull(), F.concat(F.lit("·"), F.repeat(F.lit(" "), F.length(v) - 1))))


def chunk_lines(docs: DataFrame, most: int = 128, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, line, start, end, words)``: one chunk per line that isn't blank; longer lines are cut at white space.

    Offsets are in the text. A chunk takes words as long as they fit its budget; one word alone may exceed it.
    """
    lines = F.split(text, "\n")
    starts = S.offsets(F.transform(lines, lambda x: F.length(x) + 1))
    rows = docs.select(id_col, F.posexplode(F.arrays_zip(lines.alias("t"), starts.alias("at"))).alias("line", "x")).select(id_col, "line", "x.t", F.col("x.at").alias("base"))
    rows = rows.where(F.trim("t") != "")
    weigh = lambda v: F.regexp_count(v, F.lit(P.WORD_PIECE))
    pieces = F.transform(S.hits(F.col("t"), r"\S+"), lambda s: F.struct(s["start"], s["end"], weigh(s["value"]).alias("n")))
    chunk = "struct<start:int,end:int,n:int>"
    zero = F.struct(F.lit(None).cast(chunk).alias("open"), F.array().cast(f"array<{chunk}>").alias("done"))

    def pack(acc: Column, p: Column) -> Column:
        """The open chunk grows until a word would not fit; only then is it copied to those that are done."""
        last = acc["open"]
        fits = F.coalesce(last["n"] + p["n"] <= most, F.lit(False))
        grown = F.struct(last["start"].alias("start"), p["end"].alias("end"), (last["n"] + p["n"]).alias("n"))
        done = F.when(fits | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(F.when(fits, grown).otherwise(p).cast(chunk).alias("open"), done.alias("done"))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("t").alias("end"), weigh(F.col("t")).alias("n")))
    chunks = F.when(weigh(F.col("t")) <= most, whole).otherwise(F.aggregate(pieces, zero, pack, lambda a: F.concat(a["done"], F.array(a["open"]))))
    out = S.spread(rows, id_col, "line", "base", items=chunks)
    return out.select(id_col, "line", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), F.col("n").alias("words"))


def token_windows(docs: DataFrame, most: int = 192, overlap: int = 32, id_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Overlapping windows of tokens, two short of ``most`` for the marks around them; the last is the first to reach the end."""
    size, step = most - 2, most - 2 - overlap
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step) * step).cast("int")
    rows = docs.where(n > 0).select(id_col, tokens, F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    return rows.select(id_col, "start", F.slice(tokens, F.col("start") + 1, size).alias("window"))


def line_policy(words: DataFrame, doc: str = "doc_id", line: str = "line", x: str = "x", word: str = "word") -> DataFrame:
    """``words`` plus ``kind`` and ``rule``: values after a field's label on its line, else what their own pattern says.

    A label that names no field ends the one before it.
    """
    label = F.lower(F.regexp_extract(word, "(?i)^([a-z]+):$", 1))
    kinds = F.create_map(*(F.lit(v) for pair in P.FIELD_LABELS.items() for v in pair))
    mark = F.when(label != "", F.coalesce(F.try_element_at(kinds, label), F.lit("-")))
    running = Window.partitionBy(doc, line).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(doc, line)
    has_code = F.max(F.col(word).rlike(r"(?i)(?<![A-Za-z0-9_])(?:otp|code|pin|cvv|cvc)(?![A-Za-z0-9_])")).over(whole)
    w = F.col(word)
    own = (
        F.when(w.rlike(r"(?i)[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[a-z]{2,}"), "EMAIL_ADDRESS")
        .when(w.rlike(r"(?<![A-Za-z0-9_])(?:[0-9][ -]*?){13,19}(?![A-Za-z0-9_])"), "CARD")
        .when(w.rlike(r"(?<![A-Za-z0-9_])[0-9]{4,8}(?![A-Za-z0-9_])") & has_code, "OTP")
        .when(w.rlike(r"[0-9][0-9\s().-]{5,}[0-9]"), "NUMBER")
    )
    field = F.when(label == "", F.nullif(F.last(mark, ignorenulls=True).over(running), F.lit("-")))
    out = words.withColumn("_field", field).withColumn("_own", own)
    rule = F.when(F.col("_field").isNotNull(), "explicit-sensitive-field").when(F.col("_own").isNotNull(), "token-pattern")
    return out.withColumn("kind", F.coalesce("_field", "_own")).withColumn("rule", rule).drop("_field", "_own")


def canonical(text: Column) -> Column:
    """NFC without zero-width characters, separators as one space, lower case: what the rules read."""
    clean = F.regexp_replace(composed(F.coalesce(text, F.lit(""))), P.ZERO_WIDTH, "")
    return F.lower(F.trim(F.regexp_replace(clean, r"[ \t\n\x0B\f\r_/.?=&+#:%-]+", " ")))


def norm_tokens(text: Column) -> Column:
    """Runs of letters and digits of the text in compatibility form, case folded."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def mask_value(value: Column) -> Column:
    """Tokens and plain digits as they are, anything else as up to eighteen stars."""
    open_ = value.rlike(f"^(?:{P.VAULT_TOKEN}|[0-9]+)$")
    return F.when(open_, value).otherwise(F.repeat(F.lit("*"), F.least(F.length(value), F.lit(18))))


def flatten_words(scans: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nested blocks of recognised words as rows with one line number per scan, clipped to its image; and the rejects."""
    lines = F.flatten(F.transform(F.flatten(F.transform("blocks", lambda b: b["paragraphs"])), lambda p: p["lines"]))
    rows = scans.select(key, "width", "height", F.posexplode(lines).alias("line", "l")).select(key, "width", "height", "line", F.explode("l.words").alias("word"))
    b = F.col("word.bbox")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = S.any_of([~finite(v) for v in (b["x0"], b["y0"], b["x1"], b["y1"], F.col("word.confidence"))])
    bad = sound | (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"]) | F.col("word.text").isNull() | (F.length("word.text") > 512)
    x, y = F.greatest(F.lit(0.0), b["x0"]), F.greatest(F.lit(0.0), b["y0"])
    right, bottom = F.least(F.col("width").cast("double"), b["x1"]), F.least(F.col("height").cast("double"), b["y1"])
    good = rows.where(~bad & (right > x) & (bottom > y))
    good = good.select(key, "line", F.col("word.text").alias("text"), F.col("word.confidence").alias("confidence"), x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))
    return good, rows.where(bad).select(key, "line", F.lit("invalid-word").alias("reason"))


def best_label_per_word(tokens: DataFrame, labels: Sequence[str], least: float = 0.5) -> DataFrame:
    """Each token's likeliest label (softmax), then each word's surest one that isn't O; ties go to the later name."""
    top = F.array_max("logits")
    rows = tokens.select("word", F.element_at(F.array(*map(F.lit, labels)), F.array_position("logits", top).cast("int")).alias("label"), (1 / F.aggregate("logits", F.lit(0.0), lambda s, v: s + F.exp(v - top))).alias("confidence"))
    rows = rows.where((F.col("label") != "O") & (F.col("confidence") >= least))
    best = rows.groupBy("word").agg(F.max(F.struct("confidence", "label")).alias("b"))
    return best.select("word", F.regexp_replace("b.label", "^[BI]-", "").alias("kind"), F.col("b.confidence").alias("confidence"))


def json_bytes(body: Column) -> Column:
    return F.octet_length(F.to_json(body))


def classify_form_field(type_: Column, name: Column, autocomplete: Column, inputmode: Column, id_: Column) -> Column:
    """Kinds of personal data that a form field asks for, in the rules' order."""
    t = F.lower(F.coalesce(type_, F.lit("")))
    mode = F.coalesce(inputmode, F.lit(""))
    blob = F.lower(F.concat_ws(" ", F.coalesce(autocomplete, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(id_, F.lit("")), t, mode))
    rules = (
        ("password", (t == "password") | blob.rlike("password|passwd")),
        ("email", (t == "email") | blob.rlike(r"(?:^|[\s_-])email(?:$|[\s_-])|username") | (autocomplete == "email")),
        ("tel", (t == "tel") | blob.rlike("phone|tel|mobile")),
        ("otp", blob.rlike("one-time-code|otp|totp|2fa|verification|auth.?code") | ((mode == "numeric") & blob.rlike("code|otp|pin"))),
        ("card-like", blob.rlike("cc-number|card.?number|cardno|pan.?card")),
        ("cvv", blob.rlike("cc-csc|cvv|cvc|csc|security.?code")),
        ("aadhaar", blob.rlike("aadhaar|आधार|uidai")),
        ("pan", blob.rlike(r"(?<![A-Za-z0-9_])pan(?![A-Za-z0-9_])|permanent.?account")),
        ("ifsc", blob.rlike("ifsc")),
    )
    return F.array_compact(F.array(*(F.when(test, kind) for kind, test in rules)))


def element_pii(field_type: Column, label: Column) -> Column:
    kind = F.lower(F.coalesce(field_type, F.lit("")))
    return kind.isin(*P.PII_FIELD_TYPES) | F.coalesce(label, F.lit("")).rlike(P.PII_LABEL) | kind.rlike(P.PII_LABEL)


def value_field_pii(type_: Column, value: Column) -> Column:
    """Password fields always; other fields that hold a value when it isn't empty; null for those that hold none."""
    kind = F.lower(F.coalesce(type_, F.lit("text")))
    return F.when(kind == "password", F.lit(True)).when(kind.isin(*P.NO_VALUE_TYPES), F.lit(None).cast("boolean")).otherwise(F.trim(F.coalesce(value, F.lit(""))) != "")
