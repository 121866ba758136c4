"""SQL for every query of the registry that SQL can answer, over the same tables.

The derived views are shared with the library; the rules are stated again here
in the other engine's terms: unions of rows instead of arrays in a row,
splitting and padding instead of rewriting dates, windows over tokens instead
of heights.
"""

from __future__ import annotations

from paperlane.functions import fixed
from paperlane.functions.prompts import TASK
from paperlane.plans.views import BASE_TABLES, VIEW_SQL, view_chain

_STATEMENTS = {
    **VIEW_SQL,
    "text_lines": (
        "SELECT doc_id, UNNEST(RANGE(LEN(STRING_SPLIT(text, chr(10))))) AS pos, "
        "UNNEST(STRING_SPLIT(text, chr(10))) AS line FROM {documents}"
    ),
}
_SPACE = " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)
DAY = "DATE '2000-01-01'"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_views(names: list[str], body: str, **ctes: str) -> str:
    tables = {t: t for t in BASE_TABLES}
    chain = [f"{n} AS ({sql.format(**tables)})" for n, sql in view_chain(names, _STATEMENTS)]
    chain += [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return (f"WITH {', '.join(chain)} " if chain else "") + body


def strip(x: str) -> str:
    return f"trim({x}, {_SPACE})"


def num(x: str, kind: str = "DOUBLE") -> str:
    return f"COALESCE(TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS {kind}), CAST(0 AS {kind}))"


def money(x: str) -> str:
    return num(x, "DECIMAL(30,6)")


def pdate(x: str) -> str:
    b = strip(x)
    p = lambda n: f"split_part(replace({b}, '-', '/'), '/', {n})"
    made = lambda y, m, d: f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"

    def short(y: int, m: int, d: int) -> str:
        year = f"(CASE WHEN CAST({p(y)} AS INT) >= 69 THEN '19' ELSE '20' END || {p(y)})"
        return f"CASE WHEN length({p(y)}) = 2 THEN {made(year, p(m), p(d))} END"

    return f"""CASE
      WHEN regexp_matches({b}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') OR regexp_matches({b}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$')
        THEN COALESCE({made(p(3), p(1), p(2))}, {made(p(3), p(2), p(1))})
      WHEN regexp_matches({b}, '^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}$') OR regexp_matches({b}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$')
        THEN {made(p(1), p(2), p(3))}
      WHEN regexp_matches({b}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{1,2}}$')
        THEN COALESCE({short(3, 1, 2)}, {short(3, 2, 1)}, {short(1, 2, 3)}) END"""


def any_word(words: list[str], lowered: str) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {q(w)})" for w in words) + ")"


def document_type(lowered: str) -> str:
    score = {n: "(" + "+".join(f"CAST(contains({lowered}, {q(w)}) AS INT)" for w in ws) + ")" for n, ws in fixed.TYPE_KEYWORDS.items()}
    best = f"greatest({', '.join(score.values())})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN {s} = {best} THEN '{n}'" for n, s in score.items()) + " END"


def category(lowered: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_word(w, lowered)} THEN '{n}'" for n, w in fixed.CATEGORY_KEYWORDS.items()) + " ELSE 'general' END"


def validation_kind(lowered: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_word(w, lowered)} THEN '{n}'" for n, w in fixed.VALIDATION_WORDS.items()) + " ELSE 'general' END"


def required(kind: str) -> str:
    rows = " ".join(f"WHEN {kind} = '{n}' THEN '{'|'.join(w)}'" for n, w in fixed.REQUIRED_FIELDS.items() if n != "general")
    return f"CASE {rows} ELSE 'summary' END"


def found(x: str, pattern: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, {q(pattern)}), '|')"


def words(x: str) -> str:
    spaces = "".join(f"\\x{{{ord(c):x}}}" for c in fixed.WHITESPACE)
    return f"CAST(len(regexp_extract_all({x}, {q(f'[^{spaces}]+')})) AS INT)"


def lines(x: str) -> str:
    return f"CAST(len(string_split({x}, chr(10))) AS INT)"


def summary(x: str) -> str:
    return f"CASE WHEN length({x}) > 300 THEN {x}[:300] || '...' ELSE {x} END"


def key_points(x: str) -> str:
    wanted = "length(s) > 20 AND (starts_with(s, '-') OR starts_with(s, '•') OR contains(lower(s), 'important'))"
    split = f"list_transform(string_split({x}, chr(10)), lambda s: {strip('s')})"
    return f"array_to_string(list_transform(list_filter({split}, lambda s: {wanted}), lambda s: {strip("ltrim(s, '- •')")})[1:5], '|')"


# --- validation as rows ------------------------------------------------------

_FORMAT = {
    "email": lambda v: f"regexp_matches({v}, {q(fixed.FIELD_FORMATS['email'][0])})",
    "phone": lambda v: f"regexp_matches(regexp_replace({v}, '[\\s()+-]', '', 'g'), '^\\d{{10,15}}$')",
    "date": lambda v: "(" + " OR ".join(f"regexp_matches({v}, {q(p)})" for p in fixed.FIELD_FORMATS["date"]) + ")",
    "amount": lambda v: f"regexp_matches({v}, {q(fixed.FIELD_FORMATS['amount'][0])})",
    "invoice_number": lambda v: "(" + " OR ".join(f"regexp_matches(upper({v}), {q(p)})" for p in fixed.FIELD_FORMATS["invoice_number"]) + ")",
    "tax_id": lambda v: "(" + " OR ".join(f"regexp_matches({v}, {q(p)})" for p in fixed.FIELD_FORMATS["tax_id"]) + ")",
}
_INVOICE_FIELDS = ["vendor_name", "invoice_number", "invoice_date", "due_date", "subtotal", "tax_amount", "total_amount"]


def column_fields(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS name, 'string' AS kind, {c} AS value, {c} <> '' AS filled FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


INVOICE_F = (
    column_fields("invoices", _INVOICE_FIELDS)
    + " UNION ALL SELECT doc_id, 'items', 'array', '[...]', true FROM invoices WHERE n_items > 0"
)
INVOICE_D = (
    "SELECT i.doc_id, lower(t.text) AS text_lc, CASE WHEN n_items > 0 THEN CAST(item_sum AS DECIMAL(30,6)) END AS items_total "
    "FROM invoices i JOIN invoice_texts t ON t.doc_id = i.doc_id"
)


def _wide() -> str:
    """Values and presence of the named fields, one row per document."""
    names = ["subtotal", "tax_amount", "total_amount", "invoice_date", "due_date", "vendor_name", "items"]
    value = ", ".join(f"MAX(CASE WHEN name = '{n}' THEN value END) AS {n}" for n in names)
    there = ", ".join(f"COALESCE(BOOL_OR(name = '{n}'), false) AS has_{n}" for n in names)
    given = ", ".join(f"COALESCE(BOOL_OR(name = '{n}' AND filled), false) AS given_{n}" for n in names)
    return (
        f"SELECT d.doc_id, ANY_VALUE(d.text_lc) AS text_lc, ANY_VALUE(d.items_total) AS items_total, {value}, {there}, {given} "
        "FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"
    )


def validation_ctes(amount_max: int = fixed.AMOUNT_MAX) -> dict[str, str]:
    """w: wide rows; days: read dates; iss: issues; cat: category results; val: overall result. Needs f and d."""
    days = f"SELECT doc_id, name, value, {pdate('value')} AS day FROM f WHERE contains(lower(name), 'date') AND filled"
    broken = (
        "SELECT w.doc_id, given_invoice_date AND given_due_date AND (a.day IS NULL OR b.day IS NULL) AS broken, "
        "a.day AS invoice_day, b.day AS due_day FROM w "
        "LEFT JOIN days a ON a.doc_id = w.doc_id AND a.name = 'invoice_date' "
        "LEFT JOIN days b ON b.doc_id = w.doc_id AND b.name = 'due_date'"
    )
    issue = lambda c, code, field, observed, where, source="w": (
        f"SELECT {source}.doc_id, '{c}' AS category, '{code}' AS code, {field} AS field, {observed} AS observed FROM {source} {where}"
    )
    fmt = " UNION ALL ".join(
        issue("format", f"bad_{r}", "f.name", "f.value", f"WHERE f.kind = 'string' AND contains(lower(f.name), '{r}') AND NOT {t('f.value')}", "f")
        for r, t in _FORMAT.items()
    )
    rate = f"({num('tax_amount')} / {num('subtotal')})"
    size = f"length({strip('vendor_name')})"
    all_issues = " UNION ALL ".join(
        [
            issue("consistency", "items_total_mismatch", "'total_amount'", "total_amount",
                  f"WHERE has_items AND has_total_amount AND abs(items_total - {money('total_amount')}) > 0.01"),
            issue("consistency", "tax_sum_mismatch", "'total_amount'", "total_amount",
                  f"WHERE has_subtotal AND has_tax_amount AND has_total_amount AND abs({money('subtotal')} + {money('tax_amount')} - {money('total_amount')}) > 0.01"),
            issue("consistency", "invoice_after_due", "'invoice_date'", "w.invoice_date",
                  "JOIN broken b ON b.doc_id = w.doc_id WHERE b.invoice_day > b.due_day"),
            issue("consistency", "too_far_in_future", "days.name", "days.value",
                  f"JOIN broken b ON b.doc_id = days.doc_id WHERE NOT b.broken AND days.day - {DAY} > 30", "days"),
            issue("consistency", "not_in_text", "f.name", "f.value",
                  f"JOIN d ON d.doc_id = f.doc_id WHERE f.kind = 'string' AND {strip('f.value')} <> '' AND NOT contains(d.text_lc, lower(f.value))", "f"),
            issue("consistency", "total_without_items", "'total_amount'", "''", "WHERE has_total_amount AND NOT has_items"),
            issue("consistency", "tax_without_subtotal", "'tax_amount'", "''", "WHERE has_tax_amount AND NOT has_subtotal"),
            fmt,
            issue("business_rules", "amount_too_large", "f.name", "f.value",
                  f"WHERE contains(lower(f.name), 'amount') AND f.filled AND {num('f.value')} > {amount_max}", "f"),
            issue("business_rules", "date_too_old", "days.name", "days.value", f"WHERE days.day < {DAY} - 3650", "days"),
            issue("business_rules", "date_too_far_ahead", "days.name", "days.value", f"WHERE days.day > {DAY} + 365", "days"),
            issue("business_rules", "vendor_too_short", "'vendor_name'", "vendor_name", f"WHERE given_vendor_name AND {size} < 2"),
            issue("business_rules", "vendor_too_long", "'vendor_name'", "vendor_name", f"WHERE given_vendor_name AND {size} > 100"),
            issue("business_rules", "tax_rate_unreasonable", "'tax_amount'", "tax_amount",
                  f"WHERE has_tax_amount AND has_subtotal AND {num('subtotal')} > 0 AND ({rate} < 0 OR {rate} > 0.5)"),
            issue("completeness", "low_quality", "f.name", "f.value", f"WHERE f.kind = 'string' AND length({strip('f.value')}) < 2", "f"),
            "SELECT r.doc_id, 'completeness', 'missing', r.name, '' FROM req r LEFT JOIN f ON f.doc_id = r.doc_id AND f.name = r.name AND f.filled WHERE f.name IS NULL",
        ]
    )
    # Documents of these views always have an indicator field of invoices.
    req = "SELECT d.doc_id, UNNEST(['vendor_name', 'invoice_number', 'invoice_date', 'total_amount']) AS name FROM d"
    cats = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category FROM d" for c in fixed.CHECK_CATEGORIES)
    counted = f"""
        SELECT k.doc_id, k.category, COUNT(i.code) AS n, COUNT(CASE WHEN i.code = 'missing' THEN 1 END) AS missing,
          MAX(CASE WHEN k.category = 'consistency' AND b.broken THEN 1 ELSE 0 END) AS broken
        FROM ({cats}) k LEFT JOIN iss i ON i.doc_id = k.doc_id AND i.category = k.category
        JOIN broken b ON b.doc_id = k.doc_id GROUP BY ALL"""
    scored = """
        SELECT doc_id, category, n + broken AS issues,
          CASE WHEN category = 'completeness' THEN greatest(0, 100 - 15 * missing - 10 * (n - missing))
               ELSE greatest(0, 100 - 10 * n - 20 * broken) END AS points,
          CASE WHEN category = 'completeness' THEN missing > 0 ELSE n + broken > 0 END AS failed
        FROM counted"""
    val = """
        SELECT doc_id, CAST(SUM(points) AS DOUBLE) / 400 AS score, SUM(points) >= 280 AS is_valid, SUM(issues) AS issues
        FROM cat GROUP BY doc_id"""
    return {"w": _wide(), "days": days, "broken": broken, "req": req, "iss": all_issues, "counted": counted, "cat": scored, "val": val}


def over_invoices(body: str, amount_max: int = fixed.AMOUNT_MAX) -> str:
    return with_views(["invoice_texts"], body, f=INVOICE_F, d=INVOICE_D, **validation_ctes(amount_max))


def issues_of(*codes: str, amount_max: int = fixed.AMOUNT_MAX) -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    return over_invoices(f"SELECT doc_id, code, field, COALESCE(observed, '') AS observed FROM iss WHERE code IN ({listed})", amount_max)


def category_score(name: str) -> str:
    return over_invoices(
        "SELECT doc_id, CASE WHEN failed THEN 'failed' ELSE 'passed' END AS status, CAST(issues AS INT) AS issues, "
        f"ROUND(CAST(points AS DOUBLE) / 100, 6) AS confidence FROM cat WHERE category = '{name}'"
    )


# --- analysis as rows --------------------------------------------------------

_IS_OBJECT = "(json_valid(response) AND COALESCE(CASE WHEN json_valid(response) THEN json_type(response) END, '') = 'OBJECT')"
_FIRST_DATE = "regexp_extract(response, '\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}')"
_LAST_AMOUNT = "COALESCE(regexp_extract_all(response, '\\$\\s*[\\d,]+\\.\\d{2}')[-1], '')"


def record_fields(source: str) -> str:
    """Fields of the strict or fallback invoice record of every response, private keys left out."""
    parsed = (
        f"SELECT doc_id, k AS name, CASE k WHEN 'confidence' THEN 'number' WHEN 'meta' THEN 'object' ELSE 'string' END AS kind, "
        "json_extract_string(response, '$.' || k) AS value "
        f"FROM (SELECT doc_id, response, UNNEST(json_keys(response)) AS k FROM {source} WHERE {_IS_OBJECT}) WHERE NOT starts_with(k, '_')"
    )
    blank = ["vendor_name", "vendor_address", "invoice_number", "tax_amount"]
    fallback = [(f"'{n}'", "'string'", "''") for n in blank]
    fallback += [
        ("'invoice_date'", "'string'", _FIRST_DATE),
        ("'total_amount'", "'string'", _LAST_AMOUNT),
        ("'items'", "'array'", "'[]'"),
        ("'confidence'", "'number'", "'0.5'"),
    ]
    rows = [f"SELECT doc_id, {n}, {k}, {v} FROM {source} WHERE NOT {_IS_OBJECT}" for n, k, v in fallback]
    listed = " UNION ALL ".join([parsed, *rows])
    numeric = f"SELECT doc_id, 'total_amount_numeric', 'number', CAST({money('value')} AS VARCHAR) FROM listed WHERE name = 'total_amount'"
    filled = (
        "CASE kind WHEN 'string' THEN value <> '' WHEN 'number' THEN CAST(value AS DOUBLE) <> 0 WHEN 'object' THEN value <> '{}' ELSE value <> '[]' END"
    )
    return (
        f"WITH listed AS ({listed}) SELECT *, {filled} AS filled FROM "
        f"(SELECT * FROM listed UNION ALL {numeric})"
    )


ANSWERED = "SELECT t.doc_id, t.text, r.response FROM invoice_texts t JOIN llm_responses r ON r.doc_id = t.doc_id"
ANSWERED_D = (
    f"SELECT doc_id, lower(text) AS text_lc, CASE WHEN {_IS_OBJECT} THEN CAST(NULL AS DECIMAL(30,6)) ELSE CAST(0 AS DECIMAL(30,6)) END AS items_total FROM a"
)
_CONFIDENCE = f"CASE WHEN {_IS_OBJECT} THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END"


def over_answers(body: str, **extra: str) -> str:
    return with_views(
        ["invoice_texts", "llm_responses"], body, a=ANSWERED, f=record_fields("a"), d=ANSWERED_D, **validation_ctes(), **extra
    )


_TOKENS = "SELECT *, CAST(page % 7 + doc_id % 3 AS DOUBLE) / 10 AS processing_time FROM ocr_tokens"
_FIGURES = """SELECT doc_id, CAST(COUNT(DISTINCT page) AS INT) AS pages_processed,
    CAST(COUNT(*) AS INT) AS total_items, CAST(COUNT(*) FILTER (WHERE confidence >= 0.8) AS INT) AS filtered_items,
    COALESCE(AVG(confidence) FILTER (WHERE confidence >= 0.8), 0) AS sure_mean, AVG(confidence) AS mean,
    COALESCE(string_agg(text, ' ' ORDER BY page, pos) FILTER (WHERE confidence >= 0.8), '') AS sure_text,
    string_agg(text, chr(10) ORDER BY page, pos) AS all_text FROM tok GROUP BY doc_id"""
_TIMES = "SELECT doc_id, SUM(t) AS t FROM (SELECT doc_id, page, MAX(processing_time) AS t FROM tok GROUP BY ALL) GROUP BY doc_id"
_CELLS = {
    "g0": "SELECT *, y_min - LAG(y_min) OVER (PARTITION BY doc_id, page ORDER BY y_min, pos) AS gap FROM tok",
    "g1": """SELECT *, SUM(CASE WHEN gap >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y_min, pos
               ROWS UNBOUNDED PRECEDING) AS grp,
             SUM(CASE WHEN gap >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y_min, pos
               ROWS UNBOUNDED PRECEDING) AS rw FROM g0""",
    "g2": "SELECT *, COUNT(*) OVER (PARTITION BY doc_id, page, grp) AS n FROM g1",
    "cells": """SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY doc_id, page ORDER BY grp) AS INT) AS table_no,
        CAST(rw - MIN(rw) OVER (PARTITION BY doc_id, page, grp) + 1 AS INT) AS row_no,
        CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, page, grp, rw ORDER BY x_min, y_min, pos) AS INT) AS col_no
        FROM g2 WHERE n > 1""",
}
_ELEMENT = f"""CASE WHEN length({strip('text')}) < 100 AND upper({strip('text')}) = {strip('text')} AND lower({strip('text')}) <> {strip('text')} THEN 'heading'
    WHEN length({strip('text')}) < 50 AND regexp_matches(replace({strip('text')}, ' ', ''), '^[\\p{{L}}\\p{{N}}]+$') THEN 'title'
    WHEN contains(text, chr(10)) OR length({strip('text')}) > 200 THEN 'paragraph' ELSE 'text' END"""
_TABLE_COUNT = "SELECT doc_id, COUNT(DISTINCT (page, table_no)) AS n FROM cells GROUP BY doc_id"


_RENDERED = f"""SELECT doc_id, {strip("string_agg(t, chr(10) || chr(10) ORDER BY page, table_no)")} AS t FROM (
    SELECT doc_id, page, table_no, string_agg(t, chr(10) ORDER BY row_no) AS t FROM (
      SELECT doc_id, page, table_no, row_no, string_agg(text, ' | ' ORDER BY col_no) AS t FROM cells GROUP BY ALL) GROUP BY ALL) GROUP BY doc_id"""
_KIND_COUNTS = ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE e = '{k}') AS INT) AS {k}s" for k in ("heading", "title", "paragraph", "text")
)
# Contents of the three branches, one row per document that has tokens.
_BRANCHES = f"""SELECT fig.*, ROUND(tim.t, 6) AS t, CAST(COALESCE(tabs.n, 0) AS INT) AS total_tables, headings, titles, paragraphs, texts,
    COALESCE(NULLIF(ren.t, ''), 'Found ' || CAST(COALESCE(tabs.n, 0) AS VARCHAR) || ' tables across '
      || CAST(pages_processed AS VARCHAR) || ' pages, but no text content could be extracted.') AS table_content,
    COALESCE(NULLIF({strip('all_text')}, ''), 'Extracted structure from ' || CAST(pages_processed AS VARCHAR)
      || ' pages, but no text content could be extracted.') AS structure_content
    FROM fig JOIN tim ON tim.doc_id = fig.doc_id LEFT JOIN tabs ON tabs.doc_id = fig.doc_id LEFT JOIN ren ON ren.doc_id = fig.doc_id
    JOIN (SELECT doc_id, {_KIND_COUNTS} FROM (SELECT doc_id, {_ELEMENT} AS e FROM tok) GROUP BY doc_id) k ON k.doc_id = fig.doc_id"""
_LAYOUT = {**_CELLS, "fig": _FIGURES, "tim": _TIMES, "tabs": _TABLE_COUNT, "ren": _RENDERED, "br": _BRANCHES}


def over_tokens(body: str, *more: str) -> str:
    return with_views(["ocr_tokens"], body, tok=_TOKENS, **_LAYOUT)


# Invoices recognised line by line; what each branch makes of them, and the documents that have a text then.
_LINE_TOKENS = """SELECT doc_id, CAST(i - 1 AS INT) AS pos, CAST(FLOOR((i - 1) / 4) AS INT) + 1 AS page, string_split(text, chr(10))[i] AS text,
    CAST(50 + (doc_id * 31 + (i - 1) * 17) % 50 AS DOUBLE) / 100 AS confidence,
    CAST(((i - 1) % 4) * 25 + CASE WHEN (doc_id + i - 1) % 4 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS y_min,
    CAST((doc_id * 7 + (i - 1) * 13) % 600 AS DOUBLE) AS x_min, 0.25::DOUBLE AS processing_time
    FROM (SELECT doc_id, text, UNNEST(RANGE(1, LEN(string_split(text, chr(10))) + 1)) AS i FROM src WHERE doc_id % 13 <> 0)"""
_CHOSEN = """SELECT s.doc_id, s.response, s.branch, br.doc_id IS NOT NULL AS seen, pages_processed, total_items, t * CASE WHEN branch = 'full' THEN 3 ELSE 1 END AS t,
    CASE branch WHEN 'table' THEN table_content WHEN 'structure' THEN structure_content ELSE sure_text END AS text,
    CASE WHEN br.doc_id IS NULL THEN NULL WHEN branch = 'table' THEN 0.85 WHEN branch = 'structure' THEN mean WHEN branch = 'full' THEN (sure_mean + 0.85 + mean) / 3 ELSE sure_mean END::DOUBLE AS c
    FROM (SELECT *, CASE doc_id % 5 WHEN 1 THEN 'table' WHEN 2 THEN 'structure' WHEN 3 THEN 'full' ELSE 'text' END AS branch FROM src) s
    LEFT JOIN br ON br.doc_id = s.doc_id"""


def over_recognised(body: str, **extra: str) -> str:
    return with_views(
        ["invoice_texts", "llm_responses"], body, src=ANSWERED, tok=_LINE_TOKENS, **_LAYOUT, ex=_CHOSEN,
        a="SELECT doc_id, text, response FROM ex WHERE seen AND text <> ''", f=record_fields("a"), d=ANSWERED_D, **validation_ctes(), **extra,
    )


_STATUS = """SELECT agent, COUNT(*) AS total_tasks, COUNT(*) FILTER (WHERE status = 'error') AS error_count,
    CAST(COUNT(*) FILTER (WHERE status <> 'error') AS DOUBLE) / COUNT(*) AS success_rate,
    arg_max(status, (start_ts, task_id)) AS status, MAX(start_ts) AS last_activity FROM task_log GROUP BY agent"""
_RECENT = "SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY agent ORDER BY start_ts DESC, task_id DESC) AS INT) AS recency FROM task_log"
_RUNS = """SELECT task_id % 200 AS doc_id, status = 'completed' AS success, duration AS processing_time, document_type,
    CAST(50 + task_id % 50 AS DOUBLE) / 100 AS confidence,
    (['text', 'table', 'structure', 'full'])[1 + task_id % 4] AS extraction_type FROM task_log"""


def over_log(body: str) -> str:
    return with_views(["task_log"], body, st=_STATUS, recent=_RECENT, runs=_RUNS)


_BOTH_TEXTS = "SELECT doc_id, text FROM typed_docs UNION ALL SELECT doc_id + 1000000, text FROM invoice_texts"
_ENTITY_PATTERN = {"amounts": fixed.AMOUNT_IN_TEXT, "dates": fixed.DATE_IN_TEXT, "emails": fixed.EMAIL_IN_TEXT}
_OTHER_KINDS = ["people", "organizations", "locations", "phone_numbers", "urls"]
_FOUND_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS entity_type, UNNEST(regexp_extract_all(text, {q(p)})) AS entity FROM invoice_texts"
    for k, p in _ENTITY_PATTERN.items()
)
_PAGES = """SELECT doc_id, page, (doc_id + page) % 7 <> 0 AS success, (doc_id + page) % 5 <> 0 AS analysis_success, string_agg(text, ' ' ORDER BY pos) AS extracted_content,
    AVG(confidence) AS confidence FROM ocr_tokens GROUP BY doc_id, page"""
_STREAM_PAGES = """SELECT doc_id, i AS page, (doc_id + i - 1) % 7 <> 0 AS success, string_split(text, chr(10) || chr(10))[i] AS extracted_content,
    CAST(50 + (doc_id + i - 1) % 50 AS DOUBLE) / 100 AS confidence
    FROM (SELECT doc_id, text, UNNEST(RANGE(1, LEN(string_split(text, chr(10) || chr(10))) + 1)) AS i FROM documents)"""


def folded(pages: str, views: list[str], analysed: str = "success") -> str:
    # Kinds are concatenated in the order of the entity map: dates, amounts, emails.
    lists = ", ".join(f"regexp_extract_all(extracted_content, {q(_ENTITY_PATTERN[k])})" for k in ("dates", "amounts", "emails"))
    return with_views(
        views,
        f"""SELECT doc_id, COALESCE(string_agg(extracted_content, ' ' ORDER BY page) FILTER (WHERE success), '') AS extracted_content,
          COALESCE(string_agg(array_to_string(found, '|'), '|' ORDER BY page) FILTER (WHERE {analysed} AND len(found) > 0), '') AS combined_entities,
          ROUND(COALESCE(SUM(confidence) FILTER (WHERE success), 0) / COUNT(*), 6) AS average_confidence,
          COUNT(*) AS pages_processed FROM pf GROUP BY doc_id""",
        p=pages,
        pf=f"SELECT *, flatten([{lists}]) AS found FROM p",
    )


def _prompt_sql(keys: dict[str, str], kinds: list[str], cut: dict[str, int], text: str) -> str:
    def ask(n: str) -> str:
        head = f"{q(TASK[n])} || chr(10) || {q(f'Answer with one JSON object that has the keys {keys[n]}.')} || chr(10) || chr(10)"
        return f"{head} || " + (f"{text}[:{cut[n]}]" if n in cut else text)

    return "CASE kind " + " ".join(f"WHEN '{n}' THEN {ask(n)}" for n in kinds) + " {more} ELSE " + ask("general") + " END"


_SUMMARY_ASK = "WHEN 'summary' THEN 'Summarize this text in at most 300 characters:' || chr(10) || chr(10) || text"
_FULL_PROMPT = _prompt_sql(fixed.REQUEST_KEYS, ["invoice", "contract", "form", "report", "entities"], {"entities": 2000}, "text").format(more=_SUMMARY_ASK)
_BRIEF_PROMPT = _prompt_sql(fixed.BRIEF_KEYS, ["invoice", "contract", "form"], fixed.BRIEF_CHARS, "text").format(more="")


def _report_sql(template: str, cut: int, escape: bool) -> str:
    def safe(x: str) -> str:
        return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')" if escape else x

    values = {
        "summary": safe("text[:40]"),
        "filename": safe("'f<' || CAST(doc_id AS VARCHAR) || '>.pdf'"),
        "type": safe("'a&b'"),
        "confidence": "printf('%.2f', CAST(70 + doc_id % 31 AS DOUBLE) / 100)",
        "text": safe(f"text[:{cut}]"),
    }
    pieces, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [q(before), values[name]]
    return " || ".join([*pieces, q(rest)])


_SCORED = """SELECT doc_id, score AS validation, is_valid, CAST(70 + doc_id % 31 AS DOUBLE) / 100 AS ocr,
    CAST(50 + doc_id % 50 AS DOUBLE) / 100 AS analysis FROM val"""
_QUALITY = "ROUND(ocr * 0.3::DOUBLE + analysis * 0.3::DOUBLE + validation * 0.4::DOUBLE, 12)"
_LEVEL = "CASE WHEN {s} >= 0.9 THEN 'excellent' WHEN {s} >= 0.8 THEN 'good' WHEN {s} >= 0.7 THEN 'fair' ELSE 'poor' END"


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}
    get = lambda n: f"json_extract_string(response, '$.{n}')"

    sql["s2_text_items"] = with_views(
        ["text_lines"],
        f"SELECT doc_id, CAST(pos AS INT) AS line_no, line AS text, 1.0::DOUBLE AS confidence FROM text_lines WHERE {strip('line')} <> ''",
    )
    sql["s3_normalize_ocr"] = with_views(
        ["ocr_tokens"],
        "SELECT doc_id, pos, text, confidence, x_min, y_min, x_min + 10 * length(text) AS x_max, y_min + 20 AS y_max FROM ocr_tokens",
    )
    failed = "CASE WHEN doc_id % 7 = 0 THEN 'HTTP 500' WHEN doc_id % 6 = 5 THEN 'No choices in response' END"
    sql["s4_chat_contents"] = with_views(
        ["llm_responses"],
        f"SELECT doc_id, CASE WHEN {failed} IS NULL THEN {strip('response')} END AS response, {failed} AS error FROM llm_responses",
    )
    files = """SELECT doc_id, n_chars * 20000 AS size_bytes, CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png'
        WHEN 2 THEN '.exe' WHEN 3 THEN '.tiff' ELSE '.txt' END AS extension FROM documents"""
    sql["f1_admit"] = with_views(
        [],
        """SELECT *, CASE WHEN size_bytes > 52428800 THEN 'File size exceeds maximum allowed (50MB)'
           WHEN extension IN ('.PDF', '.png', '.tiff') THEN 'accepted' ELSE 'Unsupported file format: ' || extension END AS reason FROM fl""",
        fl=files,
    )
    sql["f2_filter_confidence"] = with_views(
        ["ocr_tokens"], "SELECT doc_id, pos, page, confidence FROM ocr_tokens WHERE confidence >= 0.8"
    )
    sql["f3_require_input"] = with_views(
        ["llm_responses"],
        """SELECT doc_id, doc_id % 7 <> 0 AND response <> '' AS accepted, CASE WHEN doc_id % 7 = 0 THEN 'Invalid task format for analysis'
           WHEN response = '' THEN 'extracted_text is required for analysis task' ELSE '' END AS message FROM llm_responses""",
    )
    sql["f4_branches"] = """SELECT doc_id,
        CASE doc_id % 6 WHEN 1 THEN 'table' WHEN 2 THEN 'structure' WHEN 3 THEN 'full' ELSE 'text' END AS branch,
        CASE doc_id % 6 WHEN 0 THEN 'consistency|format|business_rules|completeness' WHEN 1 THEN 'consistency' WHEN 2 THEN 'format'
          WHEN 3 THEN 'business_rules' WHEN 4 THEN 'completeness' ELSE '' END AS categories FROM documents"""

    sql["l1_assemble_text"] = over_tokens(
        """SELECT fig.doc_id, sure_text AS extracted_content, total_items, filtered_items, pages_processed,
           ROUND(sure_mean, 6) AS confidence, ROUND(t, 6) AS processing_time FROM fig JOIN tim ON tim.doc_id = fig.doc_id"""
    )
    sql["l2_stamp_page"] = """SELECT doc_id, CAST(i AS INT) AS page, CAST(length(string_split(text, chr(10) || chr(10))[i]) AS INT) AS chars
        FROM (SELECT doc_id, text, UNNEST(RANGE(1, LEN(string_split(text, chr(10) || chr(10))) + 1)) AS i FROM documents)"""
    sql["l3_segment_tables"] = over_tokens("SELECT doc_id, page, pos, table_no FROM cells")
    sql["l4_group_rows"] = over_tokens("SELECT doc_id, page, pos, table_no, row_no, col_no FROM cells")
    sql["l5_render_tables"] = over_tokens("SELECT doc_id, table_content AS extracted_content FROM br")
    sql["l6_table_result"] = over_tokens(
        """SELECT doc_id, table_content AS extracted_content, total_tables, pages_processed, 0.85::DOUBLE AS confidence,
           t AS processing_time, 'table' AS extraction_type FROM br"""
    )
    sql["l7_classify_element"] = with_views(["ocr_tokens"], f"SELECT doc_id, pos, {_ELEMENT} AS element_type FROM ocr_tokens")
    sql["l8_structure_result"] = over_tokens(
        """SELECT doc_id, structure_content AS extracted_content, total_items AS total_elements, headings, titles, paragraphs, texts,
           pages_processed, ROUND(mean, 6) AS confidence, t AS processing_time, 'structure' AS extraction_type FROM br"""
    )
    sql["l9_full_content"] = over_tokens(
        """SELECT doc_id, sure_text AS extracted_content, CAST(filtered_items + total_tables + total_items AS INT) AS total_elements, pages_processed,
           ROUND((sure_mean + 0.85 + mean) / 3, 6) AS confidence, ROUND(3 * t, 6) AS processing_time, 'full' AS extraction_type, table_content,
           total_tables, structure_content, total_items AS elements, headings, titles, paragraphs, texts, total_items, filtered_items,
           ROUND(sure_mean, 6) AS text_confidence, ROUND(mean, 6) AS structure_confidence FROM br"""
    )
    sql["l10_extraction_confidence"] = over_tokens(
        """SELECT doc_id, ROUND(CASE WHEN doc_id % 3 = 0 AND filtered_items = 0 THEN 0.8 WHEN doc_id % 3 = 0 THEN sure_mean
           WHEN filtered_items = 0 THEN 0.5 ELSE (sure_mean + 0.5) / 2 END, 6) AS confidence FROM fig"""
    )

    sql["c1_text_stats"] = f"SELECT doc_id, CAST(length(text) AS INT) AS total_characters, {words('text')} AS total_words, {lines('text')} AS total_lines FROM documents"
    lowered = "SELECT doc_id, text, lower(text) AS lc FROM typed_docs"
    sql["c2_detect_document_type"] = with_views(["typed_docs"], f"SELECT doc_id, {document_type('lc')} AS document_type FROM t", t=lowered)
    sql["c3_categorize_document"] = with_views(["typed_docs"], f"SELECT doc_id, {category('lc')} AS category FROM t", t=lowered)
    sql["c4_detect_validation_type"] = with_views(
        ["typed_docs"],
        f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' ELSE {validation_kind('lc')} END AS validation_type FROM t",
        t=lowered,
    )
    sql["c5_route_analysis"] = with_views(
        ["typed_docs"],
        "SELECT *, CASE WHEN analysis_type IN ('invoice', 'contract', 'form', 'report') THEN analysis_type ELSE 'general' END AS branch FROM r",
        t=lowered,
        r=f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'legal' ELSE {document_type('lc')} END AS analysis_type FROM t",
    )
    sql["c6_build_prompts"] = with_views(
        ["typed_docs"],
        """SELECT doc_id, kind, CAST(length(full_p) AS INT) AS full_chars, md5(full_p) AS full_md5, CAST(length(brief) AS INT) AS brief_chars,
           md5(brief) AS brief_md5, CASE WHEN kind IN ('general', 'report', 'other') THEN 0.4 WHEN kind = 'summary' THEN 0.7 ELSE 0.3 END::DOUBLE AS temperature,
           CASE WHEN kind = 'summary' THEN 300 ELSE 2000 END AS max_tokens, 2 AS messages FROM w""",
        k="SELECT doc_id, text, UNNEST(['general', 'invoice', 'contract', 'form', 'report', 'entities', 'summary', 'other']) AS kind FROM typed_docs",
        w=f"SELECT doc_id, kind, {_FULL_PROMPT} AS full_p, {_BRIEF_PROMPT} AS brief FROM k",
    )

    either = lambda n, other: f"CASE WHEN {_IS_OBJECT} THEN {get(n)} ELSE {other} END AS {n}"
    sql["x1_parse_response_strict"] = with_views(
        ["llm_responses"],
        f"SELECT doc_id, {either('vendor_name', q(''))}, {either('invoice_date', _FIRST_DATE)}, {either('total_amount', _LAST_AMOUNT)}, {_CONFIDENCE} AS confidence FROM llm_responses",
    )
    sql["x2_parse_response_span"] = with_views(
        ["llm_responses"],
        f"""SELECT doc_id, ok AS is_json, CASE WHEN ok THEN json_extract_string(s, '$.total_amount') END AS total_amount,
           CASE WHEN NOT ok THEN 'invoice' END AS document_type, CASE WHEN NOT ok THEN response[:200] END AS summary,
           CASE WHEN ok THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
           CASE WHEN ok THEN '' ELSE {found('response', fixed.AMOUNT_IN_TEXT)} END AS amounts, response AS raw_analysis
           FROM (SELECT *, s <> '' AND json_valid(s) AS ok FROM (SELECT *, regexp_extract(response, '(?s)\\{{.*\\}}') AS s FROM llm_responses))""",
    )
    sql["x3_fallback_general"] = with_views(
        ["llm_responses"],
        "SELECT doc_id, 'general' AS document_type, 'neutral' AS sentiment, 'medium' AS urgency_level, response[:200] AS summary, 0.5::DOUBLE AS confidence, 0 AS listed FROM llm_responses",
    )
    sql["x4_fallback_invoice"] = with_views(
        ["invoice_texts", "llm_responses"],
        f"SELECT doc_id, {_FIRST_DATE} AS invoice_date, {_LAST_AMOUNT} AS total_amount, '' AS vendor_name, 0 AS items, 0.5::DOUBLE AS confidence FROM c",
        c="SELECT t.doc_id, r.response || chr(10) || t.text AS response FROM invoice_texts t JOIN llm_responses r ON r.doc_id = t.doc_id",
    )
    own = lambda v: f"CASE WHEN NOT {_IS_OBJECT} THEN '{v}' END"
    n_own = lambda n: f"CASE WHEN {_IS_OBJECT} THEN 5 ELSE {n} END"
    sql["x5_fallback_contract"] = with_views(
        ["llm_responses"],
        f"SELECT doc_id, {own('[]')} AS parties, {own('')} AS contract_date, {own('array')} AS obligations_kind, {_CONFIDENCE} AS confidence, {n_own(6)} AS fields FROM llm_responses",
    )
    sql["x6_fallback_form"] = with_views(
        ["llm_responses"],
        f"SELECT doc_id, {own('unknown')} AS form_type, CAST({own('0')} AS INT) AS total_fields, {own('array')} AS form_fields_kind, {_CONFIDENCE} AS confidence, {n_own(5)} AS fields FROM llm_responses",
    )
    sql["x7_fallback_report"] = with_views(
        ["llm_responses"],
        f"SELECT doc_id, {own('unknown')} AS report_type, {own('')} AS executive_summary, {own('array')} AS data_points_kind, {_CONFIDENCE} AS confidence, {n_own(6)} AS fields FROM llm_responses",
    )
    problem = "CASE WHEN doc_id % 5 = 0 THEN 'extracted_text is required for analysis task' WHEN doc_id % 7 = 0 THEN 'no model response' ELSE '' END"
    sql["x8_extract_error_record"] = over_answers(
        f"""SELECT a.doc_id, {problem.replace('doc_id', 'a.doc_id')} AS error, {problem.replace('doc_id', 'a.doc_id')} AS record_error,
           CASE WHEN {problem.replace('doc_id', 'a.doc_id')} <> '' THEN 0::DOUBLE ELSE {_CONFIDENCE} END AS confidence,
           CASE WHEN {problem.replace('doc_id', 'a.doc_id')} <> '' THEN 0 ELSE CAST(n AS INT) END AS fields
           FROM a JOIN (SELECT doc_id, COUNT(*) AS n FROM f GROUP BY doc_id) c ON c.doc_id = a.doc_id"""
    )
    ents = ", ".join([f"{found('text', p)} AS {k}" for k, p in _ENTITY_PATTERN.items()] + [f"'' AS {k}" for k in _OTHER_KINDS])
    sql["x9_extract_entities"] = with_views(["typed_docs", "invoice_texts"], f"SELECT doc_id, {ents} FROM b", b=_BOTH_TEXTS)
    sql["x10_extract_key_points"] = with_views(
        ["typed_docs", "invoice_texts"], f"SELECT doc_id, COALESCE({key_points('text')}, '') AS key_points FROM b", b=_BOTH_TEXTS
    )
    sql["x11_extract_numeric_amount"] = with_views(
        ["invoices"], f"SELECT doc_id, {num('total_amount')} AS total, {num('invoice_date')} AS odd FROM invoices"
    )
    sql["x12_total_amount_numeric"] = over_answers(
        "SELECT doc_id, MAX(CASE WHEN name = 'total_amount_numeric' THEN CAST(value AS DOUBLE) END) AS total_amount_numeric, CAST(COUNT(*) AS INT) AS n_fields FROM f GROUP BY doc_id"
    )
    sql["x13_parse_date_multi"] = with_views(
        ["invoices"],
        f"SELECT doc_id, invoice_date, CAST({pdate('invoice_date')} AS VARCHAR) AS invoice_day, CAST({pdate('due_date')} AS VARCHAR) AS due_day FROM invoices",
    )
    sql["x14_summarize_truncate"] = with_views(["typed_docs"], f"SELECT doc_id, {summary('text')} AS summary FROM typed_docs")
    sql["x15_parse_verdict"] = with_views(
        ["llm_responses"],
        f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE
             CASE WHEN {_IS_OBJECT} THEN CAST({get('is_valid')} AS BOOLEAN) ELSE contains(lower(response), 'valid') OR contains(lower(response), 'correct') END END AS is_valid,
           CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 WHEN 3 THEN 0.7 ELSE CASE WHEN {_IS_OBJECT} THEN 0.9 ELSE 0.7 END END::DOUBLE AS confidence,
           CASE doc_id % 5 WHEN 0 THEN 'Validation error: no response' WHEN 1 THEN 'a|b' WHEN 4 THEN CASE WHEN {_IS_OBJECT} THEN NULL ELSE '' END ELSE '' END AS issues,
           CASE doc_id % 5 WHEN 0 THEN 'Manual validation required' WHEN 1 THEN '' WHEN 4 THEN CASE WHEN {_IS_OBJECT} THEN NULL ELSE 'Manual review recommended' END
             ELSE 'Manual review recommended' END AS suggestions FROM llm_responses""",
    )
    sql["x16_drop_private_keys"] = with_views(
        ["llm_responses"],
        f"""SELECT doc_id, CAST(COUNT(*) AS INT) AS before, string_agg(k, '|' ORDER BY k) FILTER (WHERE NOT starts_with(k, '_')) AS names
           FROM (SELECT doc_id, UNNEST(json_keys(response)) AS k FROM llm_responses WHERE {_IS_OBJECT}) GROUP BY doc_id
           UNION ALL SELECT doc_id, 0, '' FROM llm_responses WHERE NOT {_IS_OBJECT}""",
    )
    sql["x16_drop_private_nested"] = with_views(
        ["invoices"],
        """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{"keep":{"_a":1,"b":[{"_c":2,"d":"' || invoice_number || '"}]},"_x":0} and more'
           ELSE '{"keep":{"b":[{"d":"' || invoice_number || '"}]}}' END AS clean FROM invoices""",
    )
    sql["x17_assemble_analysis"] = over_answers(
        f"""SELECT a.doc_id, {document_type('d.text_lc')} AS analysis_type, {category('d.text_lc')} AS category, {summary('a.text')} AS summary,
           {found('a.text', fixed.AMOUNT_IN_TEXT)} AS amounts, {found('a.text', fixed.EMAIL_IN_TEXT)} AS emails, {_CONFIDENCE} AS confidence_score,
           CAST(length(a.text) AS INT) AS total_characters, {words('a.text')} AS total_words, {lines('a.text')} AS total_lines, CAST(n AS INT) AS n_fields
           FROM a JOIN d ON d.doc_id = a.doc_id JOIN (SELECT doc_id, COUNT(*) AS n FROM f GROUP BY doc_id) c ON c.doc_id = a.doc_id"""
    )

    contacts = column_fields("vendor_contacts", ["contact_email", "contact_phone", "tax_id"]).replace("SELECT doc_id,", "SELECT doc_id + 1000000,")
    tests = " UNION ALL ".join(
        f"SELECT doc_id, name AS field, value, '{r}' AS rule, {t('value')} AS ok FROM fs WHERE kind = 'string' AND contains(name, '{r}')"
        for r, t in _FORMAT.items()
    )
    sql["v1_field_dispatch"] = with_views(["invoices", "vendor_contacts"], tests, fs=f"{INVOICE_F} UNION ALL {contacts}")
    for name, rule, column, source in [
        ("v2_valid_email", "email", "contact_email", "vendor_contacts"),
        ("v3_valid_phone", "phone", "contact_phone", "vendor_contacts"),
        ("v4_valid_date_format", "date", "invoice_date", "invoices"),
        ("v5_valid_amount_format", "amount", "total_amount", "invoices"),
        ("v6_valid_invoice_number", "invoice_number", "invoice_number", "invoices"),
        ("v7_valid_tax_id", "tax_id", "tax_id", "vendor_contacts"),
    ]:
        sql[name] = with_views([source], f"SELECT doc_id, {column} AS value, {_FORMAT[rule](column)} AS ok FROM {source}")
    sql["v8_check_items_total"] = issues_of("items_total_mismatch")
    sql["v9_check_tax_sum"] = issues_of("tax_sum_mismatch")
    sql["v10_check_date_order"] = with_views(
        ["invoices"],
        "SELECT doc_id, COALESCE(invoice_date <> '' AND due_date <> '' AND (a IS NULL OR b IS NULL), false) AS failed, COALESCE(a > b, false) AS after_due FROM r",
        r=f"SELECT doc_id, invoice_date, due_date, {pdate('invoice_date')} AS a, {pdate('due_date')} AS b FROM invoices",
    )
    sql["v11_check_future_dates"] = over_invoices(
        f"SELECT doc_id, 'too_far_in_future' AS code, name AS field, value AS observed FROM days WHERE day - {DAY} > 30"
    )
    sql["v12_check_text_presence"] = issues_of("not_in_text")
    sql["v13_check_dependencies"] = issues_of("total_without_items", "tax_without_subtotal")
    sql["v14_score_consistency"] = category_score("consistency")
    sql["v15_score_format"] = category_score("format")
    sql["v16_check_amount_ranges"] = issues_of("amount_too_large", amount_max=250000)
    sql["v17_check_date_ranges"] = issues_of("date_too_old", "date_too_far_ahead")
    sql["v18_check_vendor"] = issues_of("vendor_too_short", "vendor_too_long")
    sql["v19_check_tax_rate"] = issues_of("tax_rate_unreasonable")
    sql["v20_score_business_rules"] = category_score("business_rules").replace(
        "AS confidence FROM cat", f"AS confidence, '{'|'.join(fixed.BUSINESS_RULES)}' AS applied_rules FROM cat"
    )
    sql["v21_required_fields"] = with_views(
        ["typed_docs"], f"SELECT *, {required('kind')} AS required FROM k", t=lowered, k=f"SELECT doc_id, {validation_kind('lc')} AS kind FROM t"
    )
    by_code = lambda c, order: f"(SELECT doc_id, string_agg(field, '|' ORDER BY {order}) AS l, COUNT(*) AS n FROM iss WHERE code = '{c}' GROUP BY doc_id)"
    place = "list_position(['vendor_name','invoice_number','invoice_date','due_date','subtotal','tax_amount','total_amount','items'], {})"
    sql["v22_check_completeness"] = over_invoices(
        f"""SELECT c.doc_id, COALESCE(m.l, '') AS missing, COALESCE(q.l, '') AS low_quality, CASE WHEN failed THEN 'failed' ELSE 'passed' END AS status,
           ROUND(CAST(fc.n - COALESCE(m.n, 0) AS DOUBLE) / 4 * 100, 6) AS completeness_percentage, ROUND(CAST(points AS DOUBLE) / 100, 6) AS confidence
           FROM cat c JOIN (SELECT doc_id, COUNT(*) AS n FROM f GROUP BY doc_id) fc ON fc.doc_id = c.doc_id
           LEFT JOIN {by_code('missing', place.format('field'))} m ON m.doc_id = c.doc_id
           LEFT JOIN {by_code('low_quality', place.format('field'))} q ON q.doc_id = c.doc_id WHERE category = 'completeness'"""
    )
    sql["v23_check_ocr_presence"] = with_views(
        ["invoice_texts"],
        f"""SELECT doc_id, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, CAST(n AS INT) AS issues,
           ROUND(greatest(0, 100 - 10 * n)::DOUBLE / 100, 6) AS confidence, CAST(length(o) AS INT) AS ocr_text_length, CAST(k AS INT) AS extracted_fields
           FROM (SELECT t.doc_id, ANY_VALUE(o) AS o, COUNT(*) AS k, COUNT(*) FILTER (WHERE kind = 'string' AND {strip('value')} <> ''
             AND NOT contains(lower(o), lower(value))) AS n FROM t JOIN f ON f.doc_id = t.doc_id GROUP BY t.doc_id)""",
        f=INVOICE_F,
        t="SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE replace(text, chr(10), ' ') END AS o FROM invoice_texts",
    )
    sql["v24_overall_score"] = over_invoices(
        f"""SELECT val.doc_id, ROUND(score, 6) AS overall_score, is_valid, l AS validated_fields FROM val
           JOIN (SELECT doc_id, string_agg(name, '|' ORDER BY {place.format('name')}) AS l FROM f GROUP BY doc_id) x ON x.doc_id = val.doc_id"""
    )
    advice = "CASE category " + " ".join(f"WHEN '{c}' THEN '{fixed.CHECK_ADVICE[c]}'" for c in fixed.CHECK_CATEGORIES) + " END"
    order = f"list_position({fixed.CHECK_CATEGORIES!r}, category)"
    sql["v25_recommendations"] = over_invoices(
        f"SELECT doc_id, COALESCE(string_agg({advice}, '|' ORDER BY {order}) FILTER (WHERE failed), '') AS recommendations FROM cat GROUP BY doc_id"
    )

    sure = f"CASE WHEN d.doc_id IS NULL THEN 0::DOUBLE ELSE {_CONFIDENCE} END"
    quality = f"ROUND(COALESCE(c, 0) * 0.3::DOUBLE + {sure} * 0.3::DOUBLE + COALESCE(score, 0) * 0.4::DOUBLE, 12)"
    certain = (
        f"ROUND(least(1, COALESCE(c, 0.8) * 0.25::DOUBLE + CASE WHEN d.doc_id IS NULL THEN 0.8::DOUBLE ELSE {_CONFIDENCE} END * 0.35::DOUBLE"
        " + COALESCE(score, 0.8) * 0.4::DOUBLE), 6)"
    )
    sql["r1_compile_results"] = over_recognised(
        f"""SELECT ex.doc_id, COALESCE(total_items, 0) AS items_extracted, COALESCE(pages_processed, 0) AS pages_processed,
           CASE WHEN seen THEN branch ELSE 'text' END AS extraction_type, COALESCE(ex.text, '') AS extracted_text, ROUND(COALESCE(c, 0), 6) AS extraction_confidence,
           ROUND(COALESCE(t, 0), 6) AS processing_time, 'invoice' AS document_type, CASE WHEN d.doc_id IS NULL THEN 'general' ELSE {category('d.text_lc')} END AS category,
           {sure} AS analysis_confidence, COALESCE(is_valid, false) AS is_valid, ROUND(COALESCE(score, 0), 6) AS validation_score, CAST(COALESCE(issues, 0) AS INT) AS issues,
           CASE WHEN d.doc_id IS NULL THEN 'summary' ELSE COALESCE(m.l, '') END AS missing_fields, COALESCE({words('ex.text')}, 0) AS total_words,
           ROUND({quality}, 6) AS quality_score, {_LEVEL.format(s=quality)} AS quality_level, {certain} AS overall_confidence
           FROM ex LEFT JOIN d ON d.doc_id = ex.doc_id LEFT JOIN val ON val.doc_id = ex.doc_id
           LEFT JOIN {by_code('missing', place.format('field'))} m ON m.doc_id = ex.doc_id"""
    )
    scored = {"sc": _SCORED, "qs": f"SELECT *, {_QUALITY} AS s FROM sc"}
    over_scores = lambda body: with_views(["invoice_texts"], body, f=INVOICE_F, d=INVOICE_D, **validation_ctes(), **scored)
    sql["r2_quality_metrics"] = over_scores(
        f"SELECT doc_id, ROUND(s, 6) AS overall_quality_score, ROUND(s * CASE WHEN is_valid THEN 0.9 ELSE 0.5 END::DOUBLE, 6) AS reliability_score, {_LEVEL.format(s='s')} AS quality_level FROM qs"
    )
    parts = [("s < 0.7", "low"), ("doc_id % 4 = 0", "invalid"), ("s < 0.8", "improve"), ("s >= 0.9", "high")]
    listed = ", ".join(f"CASE WHEN {c} THEN {q(fixed.QUALITY_ADVICE[k])} END" for c, k in parts)
    sql["r3_quality_recommendations"] = over_scores(f"SELECT doc_id, concat_ws('|', {listed}) AS recommendations FROM qs")
    sql["r4_overall_confidence"] = over_scores(
        """SELECT doc_id, ROUND(least(1, CASE WHEN doc_id % 3 = 0 THEN 0.8 ELSE ocr END::DOUBLE * 0.25::DOUBLE
           + CASE WHEN doc_id % 5 = 0 THEN 0.8 ELSE analysis END::DOUBLE * 0.35::DOUBLE + validation * 0.4::DOUBLE), 6) AS overall_confidence FROM qs"""
    )
    sql["r5_envelope"] = over_log(
        """SELECT CAST(task_id AS VARCHAR) AS task_id, error IS NULL AS success, CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS status,
           COALESCE(error, '') AS message, CASE WHEN error IS NULL THEN document_type ELSE '' END AS document_type, ROUND(duration, 6) AS duration,
           CASE WHEN error IS NOT NULL THEN 0 WHEN task_id % 3 = 0 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM task_log"""
    )
    total = f"ROUND(least(1, 0.8::DOUBLE * 0.25::DOUBLE + {_CONFIDENCE} * 0.35::DOUBLE + score * 0.4::DOUBLE), 6)"
    sql["r6_run_metadata"] = over_answers(
        f"""SELECT a.doc_id, 'text' AS extraction_type, 'json' AS output_format, 'standard' AS workflow_type, 'ocr|analysis|validation' AS agents_involved,
           CASE WHEN a.doc_id % 9 <> 0 THEN ROUND(CAST(a.doc_id % 50 AS DOUBLE) / 10, 6) END AS processing_time,
           CASE WHEN a.doc_id % 9 <> 0 THEN strftime(TIMESTAMP '2000-01-01' + INTERVAL 1 SECOND * (a.doc_id + a.doc_id % 50 // 10), '%Y-%m-%d %H:%M:%S') END AS timestamp,
           {total} AS overall_confidence FROM a JOIN val ON val.doc_id = a.doc_id"""
    )
    sql["r7_combine_pages"] = folded(_PAGES, ["ocr_tokens"], "analysis_success")
    refused = """CASE WHEN ex.doc_id % 23 = 0 THEN 'document_path is required' WHEN ex.doc_id % 29 = 0 THEN 'File size exceeds maximum allowed (50MB)'
        WHEN ex.doc_id % 31 = 0 THEN 'Unsupported file format: .exe' ELSE '' END"""
    sql["r8_process_batch"] = over_recognised(
        f"""SELECT ex.doc_id, ROW_NUMBER() OVER (ORDER BY ex.doc_id) - 1 AS position, CASE WHEN ex.doc_id % 23 = 0 THEN '' ELSE '/in/' || CAST(ex.doc_id AS VARCHAR) END AS document_path,
           {refused} = '' AS success, CASE WHEN {refused} = '' THEN 'completed' ELSE 'error' END AS status, {refused} AS message,
           CASE WHEN {refused} <> '' THEN '' WHEN seen THEN branch ELSE 'text' END AS extraction_type,
           CASE WHEN {refused} = '' THEN CAST(length(COALESCE(ex.text, '')) AS INT) END AS extracted_chars,
           CASE WHEN {refused} = '' THEN 'invoice' ELSE '' END AS document_type,
           CASE WHEN {refused} = '' THEN ROUND(COALESCE(score, 0), 6) ELSE -1 END AS validation_score, CASE WHEN {refused} = '' THEN {certain} ELSE 0 END AS confidence
           FROM ex LEFT JOIN d ON d.doc_id = ex.doc_id LEFT JOIN val ON val.doc_id = ex.doc_id"""
    )

    no_ocr = f"ROUND({_CONFIDENCE} * 0.3::DOUBLE + score * 0.4::DOUBLE, 12)"
    sql["k1_write_json"] = over_answers(
        f"""SELECT a.doc_id, {_LEVEL.format(s=no_ocr)} AS quality_level, {category('d.text_lc')} AS category, {_CONFIDENCE} AS confidence,
           CASE WHEN {_IS_OBJECT} THEN '{{"tags":[{{"y":1.25}}]}}' END AS meta
           FROM a JOIN d ON d.doc_id = a.doc_id JOIN val ON val.doc_id = a.doc_id"""
    )
    sql["k1_pretty_json"] = over_scores(
        """SELECT doc_id, '{' || chr(10) || '  "doc_id" : ' || CAST(doc_id AS VARCHAR) || ',' || chr(10) || '  "is_valid" : ' || CAST(is_valid AS VARCHAR) || ',' || chr(10)
           || '  "note" : "é ' || CAST(doc_id % 7 AS VARCHAR) || '",' || chr(10) || '  "counts" : [ ' || CAST(doc_id % 3 AS VARCHAR) || ', 1 ]' || chr(10) || '}' AS json FROM qs"""
    )
    sql["k2_render_markdown"] = with_views(["typed_docs"], f"SELECT doc_id, {_report_sql(fixed.MARKDOWN_REPORT, 500, False)} AS report FROM typed_docs")
    sql["k3_write_entities_csv"] = with_views(
        ["invoice_texts"], 'SELECT doc_id, entity_type AS "Type", entity AS "Entity" FROM e', e=_FOUND_ROWS
    )
    sql["k4_render_html"] = with_views(["typed_docs"], f"SELECT doc_id, {_report_sql(fixed.HTML_REPORT, 1000, True)} AS report FROM typed_docs")
    sql["k5_write_events"] = over_log(
        """SELECT 'agent_activity' AS event_type, COUNT(*) AS events, 0::BIGINT AS failures, 0::BIGINT AS unknown, 0::BIGINT AS bad_calls, CAST(NULL AS DOUBLE) AS seconds FROM task_log
           UNION ALL SELECT 'processing_metrics', COUNT(*), COUNT(error), COUNT(error), 0, ROUND(SUM(duration), 3) FROM task_log
           UNION ALL SELECT 'api_call', COUNT(*), 0, 0, COUNT(error), NULL FROM task_log"""
    )

    sql["m1_agent_status"] = over_log(
        "SELECT agent, total_tasks, error_count, ROUND(success_rate, 6) AS success_rate, status, strftime(last_activity, '%Y-%m-%d %H:%M:%S') AS last_activity FROM st"
    )
    sql["m2_last_n"] = over_log("SELECT agent, task_id, recency FROM recent WHERE recency <= 1000")
    sql["m3_performance_metrics"] = over_log(
        """SELECT r.agent, 'last_100_tasks' AS period, COUNT(*) AS total_tasks, COUNT(*) FILTER (WHERE status = 'completed') AS successful_tasks,
           COUNT(*) FILTER (WHERE status = 'error') AS failed_tasks, ROUND(COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*)::DOUBLE, 6) AS success_rate,
           ROUND(COALESCE(AVG(duration) FILTER (WHERE status = 'completed'), 0), 6) AS average_processing_time, COALESCE(ANY_VALUE(e.l), '') AS recent_errors
           FROM recent r LEFT JOIN (SELECT agent, string_agg(CAST(task_id AS VARCHAR) || ':' || error, '|' ORDER BY recency DESC) AS l FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY agent ORDER BY recency) AS k FROM recent WHERE recency <= 100 AND status = 'error') WHERE k <= 5 GROUP BY agent) e
           ON e.agent = r.agent WHERE recency <= 100 GROUP BY r.agent"""
    )
    sql["m4_health"] = over_log("SELECT agent, status, status <> 'error' AND success_rate > 0.5 AS healthy, ROUND(success_rate, 6) AS success_rate FROM st")
    sql["m5_system_health"] = over_log(
        "SELECT BOOL_AND(status <> 'error') AS all_agents_healthy, COUNT(*) AS total_agents, COUNT(*) FILTER (WHERE status = 'completed') AS active_agents FROM st"
    )
    sql["m6_overall_statistics"] = over_log(
        """SELECT CAST(SUM(total_tasks) AS BIGINT) AS total_tasks_processed, CAST(SUM(error_count) AS BIGINT) AS total_errors,
           ROUND((SUM(total_tasks) - SUM(error_count))::DOUBLE / SUM(total_tasks)::DOUBLE, 6) AS overall_success_rate, COUNT(*) FILTER (WHERE status <> 'error') AS active_agents FROM st"""
    )
    sql["m7_recent_history"] = over_log("SELECT task_id, document_type, duration FROM task_log ORDER BY start_ts DESC, task_id DESC LIMIT 5")
    three = lambda c: ", ".join(f"ROUND({f}({c}) FILTER (WHERE success), 6) AS {f}_{c}" for f in ("avg", "min", "max"))
    sql["m8_run_report"] = over_log(
        f"""SELECT COUNT(*) AS total_tests, COUNT(*) FILTER (WHERE success) AS successful, COUNT(*) FILTER (WHERE NOT success) AS failed,
           ROUND(COUNT(*) FILTER (WHERE success) / COUNT(*)::DOUBLE, 6) AS success_rate, {three('processing_time')}, {three('confidence')} FROM runs"""
    )
    sql["m8_documents_per_type"] = over_log("SELECT document_type, COUNT(*) AS documents FROM runs WHERE success GROUP BY document_type")
    sql["m9_timing_by_document"] = over_log(f"SELECT doc_id, {three('processing_time')} FROM runs WHERE success GROUP BY doc_id")
    flags = ", ".join(f"COALESCE(MAX(CASE WHEN extraction_type = '{t}' THEN CAST(success AS INT) END), -1) AS {t}_ok" for t in fixed.EXTRACTION_TYPES)
    sql["m10_extraction_matrix"] = over_log(f"SELECT doc_id, {flags} FROM runs GROUP BY doc_id")
    sql["m11_entity_counts"] = with_views(
        ["invoice_texts"], "SELECT doc_id, entity_type, CAST(COUNT(*) AS INT) AS entities FROM e GROUP BY doc_id, entity_type", e=_FOUND_ROWS
    )
    sql["m11_entity_totals"] = with_views(
        ["invoice_texts"], "SELECT entity_type, COUNT(DISTINCT doc_id) AS documents, COUNT(*) AS entities FROM e GROUP BY entity_type", e=_FOUND_ROWS
    )
    sql["m12_issue_counts"] = over_invoices("SELECT doc_id, category, CAST(issues AS INT) AS issues FROM cat WHERE issues > 0")

    paged = """SELECT doc_id, i AS page, string_split(text, chr(10) || chr(10))[i] AS text, doc_id * 100000 + i AS id, (doc_id + i - 1) % 11 <> 0 AS answered
        FROM (SELECT doc_id, text, UNNEST(RANGE(1, LEN(string_split(text, chr(10) || chr(10))) + 1)) AS i FROM documents)"""
    total = "'$' || CAST(doc_id % 1000 AS VARCHAR) || '.00'"
    field = lambda n, k, v, more="": f"SELECT id AS doc_id, '{n}' AS name, '{k}' AS kind, {v} AS value, true AS filled FROM g WHERE answered AND text <> ''{more}"
    fields = [
        field("summary", "string", "'page ' || CAST(page AS VARCHAR)"), field("confidence", "number", "'0.9'"), field("total_amount", "string", total),
        field("total_amount_numeric", "number", "CAST(doc_id % 1000 AS VARCHAR)", f" AND {document_type('lower(text)')} = 'invoice'").replace("true AS filled", "doc_id % 1000 <> 0 AS filled"),
    ]
    sql["t1_stream_pages"] = with_views(
        [],
        f"""SELECT g.doc_id, CAST(page AS INT) AS page, text <> '' AS success, val.doc_id IS NOT NULL AS analysis_success, val.doc_id IS NOT NULL AS validation_success,
           CASE WHEN text = '' THEN 'extracted_text is required for analysis task' WHEN NOT answered THEN 'no model response' ELSE '' END AS error,
           {document_type('lower(text)')} AS document_type, {category('lower(text)')} AS category, {words('text')} AS total_words,
           CAST(len(regexp_extract_all(text, {q(fixed.AMOUNT_IN_TEXT)})) AS INT) AS amounts, ROUND(COALESCE(score, 0), 6) AS overall_score, COALESCE(is_valid, false) AS is_valid
           FROM g LEFT JOIN val ON val.doc_id = g.id""",
        g=paged, f=" UNION ALL ".join(fields),
        d="SELECT id AS doc_id, lower(text) AS text_lc, CAST(NULL AS DECIMAL(30,6)) AS items_total FROM g WHERE answered AND text <> ''", **validation_ctes(),
    )
    sql["t2_stream_combine"] = folded(_STREAM_PAGES, [])
    sql["u1_apply_per_document"] = """SELECT doc_id, doc_id % 10 <> 3 AS success, CASE WHEN doc_id % 10 = 3 THEN 'error' ELSE 'completed' END AS status,
        CASE WHEN doc_id % 10 = 3 THEN 'unreadable' ELSE '' END AS message, CASE WHEN doc_id % 10 = 3 THEN -1 ELSE CAST(length(text) AS INT) END AS chars FROM documents"""
    sql["u2_apply_in_batches"] = f"SELECT doc_id, 1 AS page, CASE WHEN doc_id % 10 = 3 THEN 0 ELSE {words('text')} END AS items FROM documents"
    return sql

