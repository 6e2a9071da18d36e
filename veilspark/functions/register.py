"""The operators' scalar forms as SQL functions, a table function of spans, and patterns from a table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import patterns as P
from .patterns import Pattern
from .text import nfc


def _text(value: str) -> str:
    return "r'" + value.replace("'", "''") + "'"


def _tier_place(tier: str) -> str:
    return f"coalesce(array_position(array({', '.join(map(_text, P.TIERS))}), {tier}), 0)"


#: Name, parameters, result, body.
SQL_FUNCTIONS = (
    ("veil_luhn", "v STRING", "BOOLEAN", "length(regexp_replace(v, '[ -]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(v, '[ -]', ''))"),
    ("veil_emails", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_text(P.PASSES[0].regex)}, 0)"),
    ("veil_mask", "v STRING", "STRING", f"CASE WHEN v RLIKE {_text(f'^(?:{P.VAULT_TOKEN}|[0-9]+)$')} THEN v ELSE repeat('*', least(length(v), 18)) END"),
    ("veil_tier_rank", "t STRING", "BIGINT", _tier_place("t")),
    ("veil_stricter_tier", "a STRING, b STRING", "STRING", f"CASE WHEN {_tier_place('a')} > 0 AND {_tier_place('b')} > 0 THEN CASE WHEN {_tier_place('a')} >= {_tier_place('b')} THEN a ELSE b END END"),
    ("veil_shown", "t STRING", "STRING", f"regexp_replace(veil_nfc(coalesce(t, '')), {_text(P.ZERO_WIDTH)}, '')"),
    ("veil_destructive_intent", "t STRING", "BOOLEAN", f"veil_shown(t) RLIKE {_text(P.DESTRUCTIVE_INTENT)}"),
    ("veil_collapsed", "t STRING", "STRING", "lower(trim(regexp_replace(veil_shown(t), r'\\s+', ' ')))"),
    ("veil_name_mismatch", "a STRING, b STRING", "BOOLEAN", "veil_collapsed(a) <> '' AND veil_collapsed(b) <> '' AND NOT contains(veil_collapsed(a), veil_collapsed(b)) AND NOT contains(veil_collapsed(b), veil_collapsed(a))"),
    (
        "veil_click_tier_wire",
        "label STRING, kind STRING",
        "STRING",
        f"CASE WHEN veil_shown(concat(coalesce(label, ''), ' ', coalesce(kind, ''))) RLIKE {_text(P.DESTRUCTIVE_LABEL)} THEN 'destructive' WHEN veil_shown(concat(coalesce(label, ''), ' ', coalesce(kind, ''))) RLIKE {_text(P.SUBMIT_LABEL)} THEN 'state-changing'"
        f" WHEN trim(veil_shown(label)) RLIKE {_text(P.NAVIGATION_LABEL)} THEN 'navigational' ELSE 'state-changing' END",
    ),
    ("veil_is_descriptor", "v STRING", "BOOLEAN", f"size(regexp_extract_all(lower(v), '[a-z]+', 0)) > 0 AND size(array_except(regexp_extract_all(lower(v), '[a-z]+', 0), array({', '.join(map(_text, P.DESCRIPTORS))}))) = 0"),
    ("veil_element_pii", "kind STRING, label STRING", "BOOLEAN", f"lower(coalesce(kind, '')) IN ({', '.join(map(_text, P.PII_FIELD_TYPES))}) OR coalesce(label, '') RLIKE {_text(P.PII_LABEL)} OR lower(coalesce(kind, '')) RLIKE {_text(P.PII_LABEL)}"),
    ("veil_heavy_page", "w DOUBLE, h DOUBLE, n BIGINT", "BOOLEAN", f"w * h >= {P.HEAVY_PIXELS} OR n >= {P.HEAVY_REGIONS}"),
    ("veil_overlap", "x DOUBLE, w DOUBLE, x2 DOUBLE, w2 DOUBLE", "DOUBLE", "greatest(0.0D, least(x + w, x2 + w2) - greatest(x, x2))"),
    (
        "veil_iou",
        "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, x2 DOUBLE, y2 DOUBLE, w2 DOUBLE, h2 DOUBLE",
        "DOUBLE",
        "CASE WHEN w * h + w2 * h2 - veil_overlap(x, w, x2, w2) * veil_overlap(y, h, y2, h2) > 0 THEN veil_overlap(x, w, x2, w2) * veil_overlap(y, h, y2, h2) / (w * h + w2 * h2 - veil_overlap(x, w, x2, w2) * veil_overlap(y, h, y2, h2)) ELSE 0.0D END",
    ),
    (
        "veil_gate",
        "passed BOOLEAN, tier STRING",
        "STRING",
        f"CASE WHEN {_tier_place('tier')} = 0 OR NOT coalesce(passed, false) THEN 'reject' WHEN tier = 'destructive' THEN 'ask' WHEN tier = 'state-changing' THEN 'confirm' ELSE 'unattended' END",
    ),
    ("veil_same_page", "a STRING, b STRING", "BOOLEAN", "substring_index(a, '#', 1) = substring_index(b, '#', 1)"),
    ("veil_json_bytes", "body STRING", "INT", "octet_length(body)"),
    ("veil_permits_unattended", "tier STRING", "BOOLEAN", "coalesce(tier IN ('reversible', 'navigational'), false)"),
    ("veil_is_probability", "p DOUBLE", "BOOLEAN", "coalesce(NOT isnan(p) AND p >= 0 AND p <= 1, false)"),
    ("veil_escalate", "verdict STRING, p_destr DOUBLE, p_off DOUBLE", "STRING", "CASE WHEN verdict = 'accept' AND (coalesce(p_destr, 0.0D) >= 0.5D OR coalesce(p_off, 0.0D) >= 0.5D) THEN 'ask' ELSE verdict END"),
    ("veil_final_tier", "remote STRING, local STRING", "STRING", "CASE WHEN veil_tier_rank(remote) > 0 THEN veil_stricter_tier(remote, local) ELSE local END"),
    (
        "veil_gate_dual_reasons",
        "verdict STRING, remote STRING, local STRING",
        "ARRAY<STRING>",
        "array_compact(array(CASE WHEN NOT (verdict <=> 'accept') THEN 'verdict-not-accept' END, CASE WHEN veil_tier_rank(remote) = 0 THEN 'remote-tier-unknown' WHEN remote <> local THEN 'tiers-differ' END,"
        " CASE WHEN NOT veil_permits_unattended(veil_final_tier(remote, local)) THEN 'tier-needs-confirmation' END))",
    ),
    (
        "veil_gate_dual",
        "verdict STRING, remote STRING, local STRING",
        "STRUCT<path STRING, final_tier STRING, reasons ARRAY<STRING>>",
        "CASE WHEN veil_tier_rank(local) = 0 THEN named_struct('path', 'reject', 'final_tier', cast(NULL AS STRING), 'reasons', array('no-local-tier')) WHEN verdict <=> 'reject' THEN named_struct('path', 'reject', 'final_tier', local, 'reasons', cast(array() AS ARRAY<STRING>))"
        " WHEN verdict <=> 'ask' THEN named_struct('path', 'ask', 'final_tier', veil_final_tier(remote, local), 'reasons', cast(array() AS ARRAY<STRING>))"
        " ELSE named_struct('path', CASE WHEN size(veil_gate_dual_reasons(verdict, remote, local)) > 0 THEN 'confirm' ELSE 'unattended' END, 'final_tier', veil_final_tier(remote, local), 'reasons', veil_gate_dual_reasons(verdict, remote, local)) END",
    ),
    (
        "veil_error_class",
        "message STRING, code STRING",
        "STRING",
        f"CASE WHEN code <=> {_text(P.ERROR_CLASSES[0][0])} THEN {_text(P.ERROR_CLASSES[0][0])} {' '.join(f'WHEN coalesce(message, {_text("unknown")}) RLIKE {_text(regex)} THEN {_text(name)}' for name, _, _, regex in P.ERROR_CLASSES)} ELSE 'other' END",
    ),
    ("veil_canonical_text", "t STRING", "STRING", "lower(trim(regexp_replace(veil_shown(t), r'[ \\t\\n\\x0B\\f\\r_/.?=&+#:%-]+', ' ')))"),
    (
        "veil_value_field_pii",
        "kind STRING, v STRING",
        "BOOLEAN",
        f"CASE WHEN lower(coalesce(kind, 'text')) = 'password' THEN true WHEN lower(coalesce(kind, 'text')) IN ({', '.join(map(_text, P.NO_VALUE_TYPES))}) THEN NULL ELSE trim(coalesce(v, '')) <> '' END",
    ),
    ("veil_finite", "v DOUBLE", "BOOLEAN", "v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')"),
    (
        "veil_clip_rect",
        "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, width DOUBLE, height DOUBLE, pad DOUBLE",
        "STRUCT<x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE>",
        "CASE WHEN least(width, ceil(x + w + pad)) > greatest(0.0D, floor(x - pad)) AND least(height, ceil(y + h + pad)) > greatest(0.0D, floor(y - pad)) THEN named_struct('x', greatest(0.0D, cast(floor(x - pad) AS DOUBLE)), 'y', greatest(0.0D, cast(floor(y - pad) AS DOUBLE)),"
        " 'w', least(width, cast(ceil(x + w + pad) AS DOUBLE)) - greatest(0.0D, cast(floor(x - pad) AS DOUBLE)), 'h', least(height, cast(ceil(y + h + pad) AS DOUBLE)) - greatest(0.0D, cast(floor(y - pad) AS DOUBLE))) END",
    ),
    (
        "veil_ratio_to_px",
        "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, width DOUBLE, height DOUBLE",
        "STRUCT<x BIGINT, y BIGINT, w BIGINT, h BIGINT>",
        "CASE WHEN veil_finite(x1) AND veil_finite(y1) AND veil_finite(x2) AND veil_finite(y2) AND x2 > x1 AND y2 > y1 THEN named_struct('x', floor(x1 * width + 0.5D), 'y', floor(y1 * height + 0.5D), 'w', floor((x2 - x1) * width + 0.5D), 'h', floor((y2 - y1) * height + 0.5D)) END",
    ),
    (
        "veil_scale_mask",
        "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, sx DOUBLE, sy DOUBLE",
        "STRUCT<x BIGINT, y BIGINT, w BIGINT, h BIGINT>",
        "named_struct('x', floor(x * sx), 'y', floor(y * sy), 'w', ceil((x + w) * sx) - floor(x * sx), 'h', ceil((y + h) * sy) - floor(y * sy))",
    ),
    ("veil_interval_iou", "a0 BIGINT, a1 BIGINT, b0 BIGINT, b1 BIGINT", "DOUBLE", "CASE WHEN a1 - a0 + b1 - b0 - greatest(0, least(a1, b1) - greatest(a0, b0)) > 0 THEN greatest(0, least(a1, b1) - greatest(a0, b0)) / (a1 - a0 + b1 - b0 - greatest(0, least(a1, b1) - greatest(a0, b0))) ELSE 0.0D END"),
    ("veil_split_share", "seed STRING, k STRING", "DOUBLE", "cast(conv(substr(sha2(concat(seed, ':', k), 256), 1, 2), 16, 10) AS INT) / 256.0D"),
)


def register_sql(spark: SparkSession) -> list[str]:
    """Create the functions for this session; their names."""
    spark.udf.register("veil_nfc", nfc)
    for name, params, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return [f[0] for f in SQL_FUNCTIONS]


class PiiSpans:
    """One row per span of a text that the passes claim, as ``document_spans`` has them; for lateral joins."""

    def __init__(self) -> None:
        import re

        self.passes = [(p, re.compile(p.regex, re.ASCII)) for p in P.PASSES]
        self.needs = {p.needs: (p.needs in ("@",) or p.needs.isalnum()) or re.compile(p.needs, re.ASCII) for p in P.PASSES if p.needs}
        self.bare, self.bare_words = re.compile(P.AADHAAR_BARE, re.ASCII), re.compile(P.AADHAAR_WORDS, re.ASCII)

    @staticmethod
    def passes_veto(veto: str | None, value: str) -> bool:
        if veto == "seven":
            return len(value.replace(" ", "").replace("-", "")) >= 7
        if veto == "luhn":
            digits = value.replace(" ", "").replace("-", "")
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))] if digits.isascii() and digits.isdigit() else []
            return 13 <= len(twice) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
        return True

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        text = text or ""
        found = []
        for p, regex in self.passes:
            test = self.needs.get(p.needs, True)
            if p.needs and not (p.needs in text if test is True else test.search(text)):
                continue
            found += [(m.start(), m.end(), p.name) for m in regex.finditer(text) if self.passes_veto(p.veto, m[0])]
        if self.bare_words.search(text):
            found += [(m.start(), m.end(), "aadhaar") for m in self.bare.finditer(text)]
        kept: list[tuple[int, int, str]] = []
        for s in found:
            if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
                kept.append(s)
        yield from sorted(kept)


def register_udtf(spark: SparkSession) -> None:
    spark.udtf.register("veil_pii_spans", F.udtf(PiiSpans, returnType="start int, end int, kind string"))


def patterns_from(rows: Iterable[Row] | DataFrame) -> tuple[Pattern, ...]:
    """Patterns from rows ``(name, regex, veto, needs, severity, ord)``, a registry of rules and so a short table."""
    got = rows.collect() if isinstance(rows, DataFrame) else list(rows)
    return tuple(Pattern(r["name"], r["regex"], r["veto"], r["needs"], r["severity"]) for r in sorted(got, key=lambda r: r["ord"]))


def pattern_table(spark: SparkSession, passes: Iterable[Pattern] = P.PASSES) -> DataFrame:
    rows = [(i, p.name, p.regex, p.veto, p.needs, p.severity) for i, p in enumerate(passes)]
    return spark.createDataFrame(rows, "ord int, name string, regex string, veto string, needs string, severity string")
