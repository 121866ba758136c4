"""Responses turned into records: strict and lenient JSON, fallbacks, one analysis row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import entities, fixed, jsontext, text as texts, values
from ..functions.sql import case, first_value, lit, struct
from ._settle import settle

_STRINGS = "cast(array() AS array<string>)"
ENTITIES = "map<string,array<string>>"


def fallback_general(response: str, summary_chars: int = 200) -> str:
    """Record for a response that is no JSON; its first `summary_chars` are the summary."""
    return struct(
        document_type="'general'",
        main_topics=_STRINGS,
        key_entities=struct(organizations=_STRINGS, people=_STRINGS, dates=_STRINGS, amounts=_STRINGS),
        sentiment="'neutral'",
        urgency_level="'medium'",
        action_items=_STRINGS,
        summary=f"substring({response}, 1, {summary_chars})",
        confidence="0.5D",
    )


def fallback_invoice(response: str) -> str:
    """Last dollar amount is the total, first date the invoice date."""
    dollars = entities.find_all(response, fixed.DOLLARS_IN_TEXT)
    return struct(
        vendor_name="''",
        vendor_address="''",
        invoice_number="''",
        invoice_date=f"regexp_extract({response}, {lit(fixed.DATE_IN_TEXT)}, 0)",
        total_amount=f"coalesce(try_element_at({dollars}, -1), '')",
        tax_amount="''",
        items=_STRINGS,
        confidence="0.5D",
    )


def fallback_contract() -> str:
    return struct(
        parties=_STRINGS,
        contract_date="''",
        effective_date="''",
        key_clauses=_STRINGS,
        obligations=_STRINGS,
        confidence="0.5D",
    )


def fallback_form() -> str:
    return struct(
        form_fields=_STRINGS, form_type="'unknown'", total_fields="0", completed_fields="0", confidence="0.5D"
    )


def fallback_report() -> str:
    return struct(
        report_type="'unknown'",
        executive_summary="''",
        key_findings=_STRINGS,
        recommendations=_STRINGS,
        data_points=_STRINGS,
        confidence="0.5D",
    )


def fallback_record(response: str, branch: str) -> str:
    """Record of the branch's fixed shape, as VARIANT, for a response that is no JSON."""
    shapes = {
        "invoice": fallback_invoice(response),
        "contract": fallback_contract(),
        "form": fallback_form(),
        "report": fallback_report(),
    }
    return case(
        [(f"{branch} = '{name}'", f"to_variant_object({record})") for name, record in shapes.items()],
        f"to_variant_object({fallback_general(response)})",
    )


def parse_response_strict(response: str, branch: str) -> str:
    """The response's own JSON object, without private keys, if it is nothing else; otherwise the fallback record."""
    return f"coalesce({jsontext.public_object(response)}, {fallback_record(response, branch)})"


def parse_response_span(df: DataFrame, response: str = "response", kind: str = "kind", summary_chars: int = 200) -> DataFrame:
    """JSON between the outer braces, else a record built from the raw response.

    Adds `parsed` (VARIANT or NULL), `raw_analysis`, `document_type`, `summary`,
    `confidence`, `entities` and `key_points`; the last five are taken from
    the JSON where it was found, from the fallback otherwise.
    """

    def either(path: str, kind_of: str, fallback: str) -> str:
        return f"IF(parsed IS NOT NULL, try_variant_get(parsed, '$.{path}', '{kind_of}'), {fallback})"

    short_entities = entities.extract_entities(response, entities.KINDS_SHORT)
    return df.withColumn("parsed", F.expr(jsontext.span_object(response))).selectExpr(
        "*",
        f"{response} AS raw_analysis",
        f"{either('document_type', 'string', kind)} AS document_type",
        f"{either('summary', 'string', f'substring({response}, 1, {summary_chars})')} AS summary",
        f"{either('confidence', 'double', '0.8D')} AS confidence",
        f"{either('entities', ENTITIES, short_entities)} AS entities",
        f"{either('key_points', 'array<string>', texts.key_points(response))} AS key_points",
    )


def parse_verdict(response: str) -> str:
    """Verdict of a validating model: JSON, else words, and a refusal if there is no response.

    Words are looked for as substrings, so `invalid` counts as `valid`.
    """
    get = lambda name, kind: f"try_variant_get(v.json, '$.{name}', '{kind}')"
    from_json = struct(
        is_valid=get("is_valid", "boolean"),
        confidence=get("confidence", "double"),
        issues=get("issues", "array<string>"),
        suggestions=get("suggestions", "array<string>"),
    )
    from_words = struct(
        is_valid=f"contains(lower({response}), 'valid') OR contains(lower({response}), 'correct')",
        confidence="0.7D",
        issues=_STRINGS,
        suggestions=f"array({lit(fixed.REVIEW_ADVICE)})",
    )
    refused = struct(
        is_valid="false",
        confidence="0D",
        issues="array('Validation error: no response')",
        suggestions=f"array({lit(fixed.REVALIDATE_ADVICE)})",
    )
    # Bound within a struct: an array element that is NULL as a whole would lose its type.
    verdict = struct(json=jsontext.strict_object(response))
    chosen = case([(f"{response} IS NULL", refused), ("v.json IS NOT NULL", from_json)], from_words)
    return first_value(verdict, "v", chosen)


def add_total_amount_numeric(members: str) -> str:
    """Member `total_amount_numeric` beside `total_amount`, as a decimal, beyond its digits as a double; a total that is no string counts as 0.

    `members` is a map of VARIANTs.
    """
    total = f"try_element_at({members}, 'total_amount')"
    written = f"try_variant_get({total}, '$', 'string')"
    amount = f"coalesce(cast({values.money_or_null(written)} AS variant), cast({values.numeric_amount(written)} AS variant))"
    is_text = f"schema_of_variant({total}) = 'STRING'"
    number = f"IF({is_text}, {amount}, cast(cast(0 AS {values.MONEY}) AS variant))"
    rest = f"map_filter({members}, (k, v) -> k <> 'total_amount_numeric')"
    return (
        f"IF(map_contains_key({members}, 'total_amount'), "
        f"map_concat({rest}, map('total_amount_numeric', {number})), {members})"
    )


def extract_error_record(error: str) -> str:
    """What stands in for the details of a failed analysis."""
    return f"to_variant_object({struct(error=error, confidence='0D')})"


def with_fields(df: DataFrame, branch: str, record: str = "_record") -> DataFrame:
    """Finish a record: no private keys on its top level, the total as a number; add what validation needs of it.

    Adds `record`, `fields` and `items_total`. Private keys below the top
    level went when the response was parsed.
    """
    members = jsontext.drop_private_keys(f"try_variant_get({record}, '$', 'map<string,variant>')")
    return (
        df.withColumn("_members", F.expr(members))
        .withColumn(
            "record",
            F.expr(f"to_variant_object(IF({branch} = 'invoice', {add_total_amount_numeric('_members')}, _members))"),
        )
        .withColumn("fields", F.expr(jsontext.fields_of("record")))
        .withColumn("items_total", F.expr(jsontext.items_total(record, values.money_or_null)))
        .drop("_members")
    )


def analyze(
    df: DataFrame,
    text: str = "text",
    response: str = "response",
    requested: str = "requested_type",
    entity_response: str | None = None,
    summary_response: str | None = None,
    summary_chars: int = 300,
) -> DataFrame:
    """Add one `analysis` struct per document, plus `fields` and `items_total` for validation.

    Row by row, no shuffle. A document without text or response gets an
    `analysis.error` and no fields; it stays in the output.
    """
    found = entities.extract_entities(text)
    if entity_response is not None:
        from_json = f"try_variant_get({jsontext.strict_object(entity_response)}, '$', '{ENTITIES}')"
        by_pattern = entities.extract_entities(entity_response)
        found = f"IF({entity_response} IS NULL, cast(map() AS {ENTITIES}), coalesce({from_json}, {by_pattern}))"
    summary = texts.summarize_truncate(text, summary_chars)
    if summary_response is not None:
        summary = f"coalesce(substring({texts.strip(summary_response)}, 1, {summary_chars}), {summary})"
    error = case(
        [
            (f"coalesce(length({text}), 0) = 0", "'extracted_text is required for analysis task'"),
            (f"{response} IS NULL", "'no model response'"),
        ]
    )
    staged = (
        df.withColumns({"_error": F.expr(error), "_lower": F.expr(f"lower({text})")})
        .withColumn("_type", F.expr(texts.route_analysis(requested, text, "_lower")))
        .withColumn("_branch", F.expr(texts.analysis_branch("_type")))
        .withColumn(
            "_record",
            F.expr(
                f"IF(_error IS NULL, {parse_response_strict(response, '_branch')}, {extract_error_record('_error')})"
            ),
        )
    )
    staged = settle(staged, [*df.columns, "_lower"], ["_error", "_type", "_branch", "_record"])
    staged = with_fields(staged, "_branch")
    analysis = struct(
        error="_error",
        analysis_type="_type",
        category=texts.categorize_document(text, "_lower"),
        summary=summary,
        entities=found,
        detailed_analysis="record",
        confidence_score="coalesce(try_variant_get(_record, '$.confidence', 'double'), 0.8D)",
        text_stats=texts.text_stats(text),
    )
    done = staged.selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"{analysis} AS analysis",
        "IF(_error IS NULL, fields, NULL) AS fields",
        "IF(_error IS NULL, items_total, NULL) AS items_total",
    )
    return settle(done, df.columns, ["analysis", "fields", "items_total"])
