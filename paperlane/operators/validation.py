"""Rule checks over extracted fields, scored per document.

A document carries `fields`, a map from name to (kind, value, filled), so an
absent key, a null and an empty value stay distinguishable, and `items_total`,
the exact sum of its line items (NULL if it has no list of items). Every check
is an expression over the row: issues are collected in arrays of the same row,
and scoring counts them. Nothing here shuffles.

Penalties are added up as whole percentage points so that thresholds are exact.
The checks are SQL expressions over these columns of `prepare`:
`_f` fields, `_e` their entries with lower-cased name and stripped length, `_d` given date fields with the day read from
them, `_lower` the text in lower case.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as texts, values
from ..functions.jsontext import FIELDS
from ._settle import settle
from ..functions.sql import any_of, array, case, lit, listed, struct

ISSUE = "struct<check:string,code:string,field:string,observed:string,expected:string>"
_CENT = f"cast({fixed.AMOUNT_TOLERANCE} AS decimal(3,2))"


def issue(check: str, code: str, field: str, observed: str = "cast(NULL AS string)", expected: str = "") -> str:
    """Issue as a struct; `code` is a name or an expression in parentheses, `field` an expression."""
    return struct(
        check=lit(check),
        code=code if code.startswith("(") else lit(code),
        field=field,
        observed=observed,
        expected=lit(expected),
    )


def has(name: str) -> str:
    return f"map_contains_key(_f, '{name}')"


def value_of(name: str) -> str:
    return f"try_element_at(_f, '{name}').value"


def given(name: str) -> str:
    return f"coalesce(try_element_at(_f, '{name}').filled, false)"


def money_of(name: str) -> str:
    return values.money(value_of(name))


def day_of(name: str) -> str:
    return f"get(filter(_d, d -> d.name = '{name}'), 0).day"


def prepare(df: DataFrame, fields: str = "fields", text: str = "text") -> DataFrame:
    """Columns the checks read, each worked out once."""
    flat = struct(
        key="e.key",
        low="lower(e.key)",
        kind="e.value.kind",
        value="e.value.value",
        filled="e.value.filled",
        size=f"IF(e.value.kind = 'string', length({texts.strip('e.value.value')}), NULL)",
    )
    dated = "filter(_e, e -> contains(e.low, 'date') AND e.filled)"
    day = struct(name="e.key", raw="e.value", day=values.parse_date("e.value"))
    return (
        df.withColumns(
            {
                "_f": F.expr(f"coalesce({fields}, cast(map() AS {FIELDS}))"),
                "_e": F.expr(f"transform(coalesce(map_entries({fields}), array()), e -> {flat})"),
                "_lower": F.expr(f"lower(coalesce({text}, ''))"),
            }
        )
        .withColumn("_d", F.expr(f"transform({dated}, e -> {day})"))
    )


# --- consistency -----------------------------------------------------------


def check_items_total(items_total: str = "items_total") -> str:
    """Items that do not add up to the total; sums that are too long for exact cents are said to be so."""
    off = f"abs({items_total} - {money_of('total_amount')}) > {_CENT}"
    found = issue("amounts", "items_total_mismatch", "'total_amount'", value_of("total_amount"), "sum of items")
    applies = f"{has('items')} AND {has('total_amount')}"
    unsummed = f"({items_total} IS NULL AND try_element_at(_f, 'items').kind = 'array')"
    too_large = f"({unsummed} OR {_too_large('total_amount')})"
    return case([(f"{applies} AND {too_large}", _not_compared()), (f"{applies} AND {off}", found)])


def _too_large(name: str) -> str:
    return f"coalesce({values.money_too_large(value_of(name))}, false)"


def _not_compared() -> str:
    return issue("amounts", "amount_not_comparable", "'total_amount'", value_of("total_amount"), "at most 30 digits")


def check_tax_sum() -> str:
    off = f"abs({money_of('subtotal')} + {money_of('tax_amount')} - {money_of('total_amount')}) > {_CENT}"
    found = issue("amounts", "tax_sum_mismatch", "'total_amount'", value_of("total_amount"), "subtotal + tax")
    names = ("subtotal", "tax_amount", "total_amount")
    applies = " AND ".join(has(n) for n in names)
    too_large = any_of(_too_large(n) for n in names)
    return case([(f"{applies} AND {too_large}", _not_compared()), (f"{applies} AND {off}", found)])


def date_order_failed() -> str:
    """Both dates are given but one cannot be read: the date check as a whole fails."""
    unread = f"({day_of('invoice_date')} IS NULL OR {day_of('due_date')} IS NULL)"
    return f"({given('invoice_date')} AND {given('due_date')} AND {unread})"


def check_date_order() -> str:
    found = issue("dates", "invoice_after_due", "'invoice_date'", value_of("invoice_date"), "not after due_date")
    return case([(f"{day_of('invoice_date')} > {day_of('due_date')}", found)])


def check_future_dates(as_of: str, days: int = fixed.FUTURE_DAYS_SOFT) -> str:
    found = issue("dates", "too_far_in_future", "d.name", "d.raw", f"at most {days} days ahead")
    return f"transform(filter(_d, d -> datediff(d.day, {as_of}) > {days}), d -> {found})"


def check_text_presence(lowered: str = "_lower", check: str = "text") -> str:
    """String fields whose value does not occur in the text, ignoring case."""
    found = issue(check, "not_in_text", "e.key", "e.value", "value in text")
    return f"transform(filter(_e, e -> e.size > 0 AND NOT contains({lowered}, lower(e.value))), e -> {found})"


def check_dependencies() -> str:
    no_items = issue("dependencies", "total_without_items", "'total_amount'", expected="items")
    no_subtotal = issue("dependencies", "tax_without_subtotal", "'tax_amount'", expected="subtotal")
    return listed(
        case([(f"{has('total_amount')} AND NOT {has('items')}", no_items)]),
        case([(f"{has('tax_amount')} AND NOT {has('subtotal')}", no_subtotal)]),
    )


# --- format ----------------------------------------------------------------


def format_tests() -> str:
    """(field, value, rule, ok) for every string field and every rule its name contains."""
    tried = [
        case([(f"contains(e.low, '{rule}')", struct(field="e.key", value="e.value", rule=lit(rule), ok=test("e.value")))])
        for rule, test in values.FORMAT_TESTS.items()
    ]
    return f"flatten(transform(filter(_e, e -> e.kind = 'string'), e -> {listed(*tried)}))"


def check_formats() -> str:
    """Issues of the failed tests; fields that pass all of theirs are left out first."""
    failing = [f"(contains(e.low, '{rule}') AND NOT {test('e.value')})" for rule, test in values.FORMAT_TESTS.items()]
    found = [
        case([(condition, issue("format", f"bad_{rule}", "e.key", "e.value", "known format"))])
        for rule, condition in zip(values.FORMAT_TESTS, failing)
    ]
    suspects = f"filter(_e, e -> e.kind = 'string' AND {any_of(failing)})"
    return f"flatten(transform({suspects}, e -> {listed(*found)}))"


# --- business rules --------------------------------------------------------


def check_amount_ranges(maximum: int = fixed.AMOUNT_MAX) -> str:
    large = f"contains(e.low, 'amount') AND e.filled AND {values.numeric_amount('e.value')} > {maximum}"
    found = issue("amount_ranges", "amount_too_large", "e.key", "e.value", f"at most {maximum}")
    return f"transform(filter(_e, e -> {large}), e -> {found})"


def check_date_ranges(as_of: str, past: int = fixed.PAST_DAYS_MAX, future: int = fixed.FUTURE_DAYS_MAX) -> str:
    old = issue("date_ranges", "date_too_old", "d.name", "d.raw", f"within {past} days")
    ahead = issue("date_ranges", "date_too_far_ahead", "d.name", "d.raw", f"within {future} days")
    return (
        f"concat(transform(filter(_d, d -> d.day < date_sub({as_of}, {past})), d -> {old}), "
        f"transform(filter(_d, d -> d.day > date_add({as_of}, {future})), d -> {ahead}))"
    )


def vendor_failed() -> str:
    """A vendor that is given but is no string cannot be checked."""
    return f"({given('vendor_name')} AND try_element_at(_f, 'vendor_name').kind <> 'string')"


def check_vendor() -> str:
    size = f"length({texts.strip(value_of('vendor_name'))})"
    shortest, longest = fixed.VENDOR_LENGTH
    applies = f"{given('vendor_name')} AND NOT {vendor_failed()}"
    found = lambda code: issue("vendor_validity", code, "'vendor_name'", value_of("vendor_name"))
    return case(
        [
            (f"{applies} AND {size} < {shortest}", found("vendor_too_short")),
            (f"{applies} AND {size} > {longest}", found("vendor_too_long")),
        ]
    )


def check_tax_rate(maximum: float = fixed.TAX_RATE_MAX) -> str:
    tax, subtotal = (values.numeric_amount(value_of(n)) for n in ("tax_amount", "subtotal"))
    rate = f"try_divide({tax}, {subtotal})"
    applies = f"{has('tax_amount')} AND {has('subtotal')} AND {subtotal} > 0"
    found = issue("tax_calculations", "tax_rate_unreasonable", "'tax_amount'", value_of("tax_amount"))
    return case([(f"{applies} AND ({rate} < 0 OR {rate} > {maximum})", found)])


# --- completeness ----------------------------------------------------------


def required_fields(document_type: str) -> str:
    special = [(f"{document_type} = '{n}'", array(w)) for n, w in fixed.REQUIRED_FIELDS.items() if n != "general"]
    return case(special, array(fixed.REQUIRED_FIELDS["general"]))


def missing_fields(required: str = "_required") -> str:
    return f"filter({required}, n -> NOT coalesce(try_element_at(_f, n).filled, false))"


def low_quality_fields() -> str:
    return "transform(filter(_e, e -> e.size < 2), e -> e.key)"


def completeness_percentage(required: str = "_required", missing: str = "_missing") -> str:
    """Fields minus missing ones over required ones; above 100 when there are many extra fields."""
    return f"(cast(size(_f) - size({missing}) AS double) / size({required}) * 100)"


# --- scores ----------------------------------------------------------------

CATEGORY = f"struct<category:string,status:string,points:int,confidence:double,issues:array<{ISSUE}>>"


def _category(name: str, issues: str, lost: str, failed: str) -> str:
    """Result of one category; `lost` is the penalty in whole percent."""
    points = f"greatest(0, 100 - ({lost}))"
    return struct(
        category=lit(name),
        status=f"IF({failed}, 'failed', 'passed')",
        points=points,
        confidence=f"{points} / 100D",
        issues=issues,
    )


def _scored(name: str, issues: str, broken: str | None = None) -> str:
    """10 points off per issue, 20 per check that could not run; such a check is listed too."""
    if broken is None:
        return _category(name, issues, f"size({issues}) * 10", f"size({issues}) > 0")
    crash = f"array({issue(name, 'check_failed', lit(''))})"
    return _category(
        name,
        f"IF({broken}, concat({issues}, {crash}), {issues})",
        f"size({issues}) * 10 + int({broken}) * 20",
        f"size({issues}) > 0 OR {broken}",
    )


def recommendations(categories: str = "_categories") -> str:
    advice = case([(f"c.category = '{n}'", lit(s)) for n, s in fixed.CHECK_ADVICE.items()])
    return f"transform(filter({categories}, c -> c.status = 'failed'), c -> {advice})"


def categories_of(validation_type: str) -> str:
    """Check categories a validation type stands for; an unknown type stands for none."""
    singles = [(f"{validation_type} = '{n}'", array([n])) for n in fixed.CHECK_CATEGORIES]
    return case(
        [(f"{validation_type} = 'comprehensive'", array(fixed.CHECK_CATEGORIES)), *singles],
        "cast(array() AS array<string>)",
    )


def with_issues(df: DataFrame, as_of: dt.date, items_total: str = "items_total", text: str = "text") -> DataFrame:
    """Issue arrays of all categories over a prepared frame."""
    day = f"DATE '{as_of.isoformat()}'"
    date_issues = f"concat({listed(check_date_order())}, {check_future_dates(day)})"
    consistency = ", ".join(
        [
            listed(check_items_total(items_total), check_tax_sum()),
            f"IF(_dates_broken, cast(array() AS array<{ISSUE}>), {date_issues})",
            check_text_presence(),
            check_dependencies(),
        ]
    )
    business = ", ".join([check_amount_ranges(), check_date_ranges(day), listed(check_vendor(), check_tax_rate())])
    required = required_fields("_validation_type")
    return (
        df.withColumns(
            {
                "_dates_broken": F.expr(date_order_failed()),
                "_vendor_broken": F.expr(vendor_failed()),
                "_validation_type": F.expr(texts.detect_validation_type("map_keys(_f)", text, "_lower")),
            }
        )
        .withColumns(
            {
                "_consistency": F.expr(f"concat({consistency})"),
                "_format": F.expr(check_formats()),
                "_business": F.expr(f"concat({business})"),
                "_required": F.expr(required),
                "_weak": F.expr(low_quality_fields()),
            }
        )
        .withColumn("_missing", F.expr(missing_fields()))
    )


_REPORTED = ["_f", "_categories", "_required", "_missing", "_weak", "_business"]


def validate(
    df: DataFrame,
    as_of: dt.date,
    validation_type: str = "comprehensive",
    ocr_text: str | None = None,
    fields: str = "fields",
    items_total: str = "items_total",
    text: str = "text",
) -> DataFrame:
    """Add a `validation` struct to every document.

    `validation_type` is `comprehensive`, one of the categories, or the name of
    a column of these; an unknown type checks nothing and scores 0. `ocr_text`
    names a column with the recognised text to compare with as well. A document
    without fields gets `validation.error` and score 0.
    """
    staged = with_issues(prepare(df, fields, text), as_of, items_total, text)
    incomplete = (
        f"concat(transform(_missing, n -> {issue('required_fields', 'missing', 'n')}), "
        f"transform(_weak, n -> {issue('field_quality', 'low_quality', 'n')}))"
    )
    results = {
        "consistency": _scored("consistency", "_consistency", "_dates_broken"),
        "format": _scored("format", "_format"),
        "business_rules": _scored("business_rules", "_business", "_vendor_broken"),
        "completeness": _category(
            "completeness", incomplete, "size(_missing) * 15 + size(_weak) * 10", "size(_missing) > 0"
        ),
    }
    requested = validation_type if validation_type in df.columns else lit(validation_type)
    wanted = [case([(f"{requested} IN ('comprehensive', '{n}')", c)]) for n, c in results.items()]
    if ocr_text is not None:
        lowered = f"lower({ocr_text})"
        staged = staged.withColumn("_ocr", F.expr(check_text_presence(lowered, "ocr_text")))
        wanted.append(case([(f"{ocr_text} IS NOT NULL", _scored("ocr_consistency", "_ocr"))]))
    categories = f"IF(size(_f) > 0, {listed(*wanted)}, cast(array() AS array<{CATEGORY}>))"
    staged = settle(staged.withColumn("_categories", F.expr(categories)), list(df.columns), _REPORTED)
    staged = staged.withColumn("_points", F.expr("aggregate(_categories, 0, (total, c) -> total + c.points)"))
    number = "size(_categories)"
    score = f"coalesce(try_divide(cast(_points AS double), {number} * 100), 0D)"
    limit = round(fixed.VALID_SCORE * 100)
    report = struct(
        error="IF(size(_f) > 0, NULL, 'extracted_data is required for validation task')",
        validation_type=requested,
        overall_score=score,
        is_valid=f"({number} > 0 AND _points >= {number} * {limit})",
        confidence=score,
        categories="_categories",
        recommendations=recommendations(),
        validated_fields="map_keys(_f)",
        required_fields="_required",
        missing_fields="_missing",
        low_quality_fields="_weak",
        applied_rules=f"IF(size(_f) > 0 AND {requested} IN ('comprehensive', 'business_rules'), {array(fixed.BUSINESS_RULES)}, {array([])})",
        rule_violations="transform(_business, i -> concat_ws(': ', i.field, i.code))",
        completeness_percentage=completeness_percentage(),
    )
    return staged.select(*df.columns, F.expr(report).alias("validation"))


def text_against_ocr(df: DataFrame, ocr_text: str, fields: str = "fields") -> DataFrame:
    """Only the comparison with recognised text: issues, score, text length, field count."""
    staged = prepare(df, fields, ocr_text).withColumn("_ocr", F.expr(check_text_presence("_lower", "ocr_text")))
    report = _scored("ocr_consistency", "_ocr")
    return staged.select(
        *df.columns,
        F.expr(report).alias("ocr_consistency"),
        F.expr(f"length(coalesce({ocr_text}, ''))").alias("ocr_text_length"),
        F.expr("size(_f)").alias("extracted_fields"),
    )


def field_rows(df: DataFrame, key: str = "doc_id", fields: str = "fields") -> DataFrame:
    """One row per document and field, for joins and exports."""
    return df.select(key, F.explode(F.col(fields)).alias("field", "entry")).select(
        key, "field", "entry.kind", "entry.value", "entry.filled"
    )


def issue_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, category and issue."""
    return (
        df.select(key, F.explode("validation.categories").alias("c"))
        .select(key, F.col("c.category").alias("category"), F.explode("c.issues").alias("i"))
        .select(key, "category", "i.*")
    )
