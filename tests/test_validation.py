"""Rules at their limits, on documents written out by hand."""

import datetime as dt
import json

import pytest

from paperlane.operators import analysis, results, validation
from pyspark.sql import functions as F

TODAY = dt.date(2024, 6, 1)


def validated(spark, records, texts=None, **options):
    """Validation of dicts given as model responses, by position."""
    rows = [(i, json.dumps(r), (texts or {}).get(i, "text")) for i, r in enumerate(records)]
    frame = spark.createDataFrame(rows, "doc_id int, response string, text string")
    record = frame.withColumn("_record", F.expr(analysis.parse_response_strict("response", "'none'")))
    with_fields = analysis.with_fields(record, "'none'")
    out = validation.validate(with_fields, TODAY, **options).select("doc_id", "validation").collect()
    return [r.validation for r in sorted(out, key=lambda r: r.doc_id)]


def codes(report, category=None):
    return sorted(i.code for c in report.categories if category in (None, c.category) for i in c.issues)


def one(spark, record, category, **options):
    return codes(validated(spark, [record], **options)[0], category)


def day(offset):
    return (TODAY + dt.timedelta(days=offset)).strftime("%m/%d/%Y")


def test_items_total_tolerance(spark):
    make = lambda total: {"items": [{"total_price": "100.00"}], "total_amount": total}
    reports = validated(spark, [make("100.01"), make("100.02"), make("$99.98"), {"items": "x", "total_amount": "5"}])
    assert ["items_total_mismatch" in codes(r) for r in reports] == [False, True, True, False]


def test_tax_sum_and_dependencies(spark):
    full = {"subtotal": "90", "tax_amount": "10", "total_amount": "100.01", "items": []}
    off = {**full, "total_amount": "100.02"}
    reports = validated(spark, [full, off, {"tax_amount": "1", "total_amount": "1"}, {"tax_amount": None, "subtotal": None}])
    assert ["tax_sum_mismatch" in codes(r) for r in reports] == [False, True, False, False]
    assert {"total_without_items", "tax_without_subtotal"} <= set(codes(reports[2]))
    assert "tax_without_subtotal" not in codes(reports[3])


def test_date_order_and_failed_check(spark):
    later = {"invoice_date": "02/01/2024", "due_date": "01/31/2024"}
    broken = {"invoice_date": "soon", "due_date": day(400)}
    alone = {"invoice_date": "soon"}
    reports = validated(spark, [later, broken, alone])
    assert "invoice_after_due" in codes(reports[0])
    assert "check_failed" in codes(reports[1], "consistency") and "too_far_in_future" not in codes(reports[1])
    assert reports[1].categories[0].points == 100 - 20 - 2 * 10  # failed check, two values not in the text
    assert "check_failed" not in codes(reports[2])


@pytest.mark.parametrize(
    "offset, soft, old, ahead",
    [(30, 0, 0, 0), (31, 1, 0, 0), (365, 1, 0, 0), (366, 1, 0, 1), (-3650, 0, 0, 0), (-3651, 0, 1, 0)],
)
def test_date_limits(spark, offset, soft, old, ahead):
    found = one(spark, {"start_date": day(offset)}, None)
    assert (found.count("too_far_in_future"), found.count("date_too_old"), found.count("date_too_far_ahead")) == (soft, old, ahead)


def test_text_presence_ignores_case_and_blank_values(spark):
    report = validated(spark, [{"a": "ACME ltd", "b": "  ", "c": "missing", "d": 7}], {0: "from Acme LTD."})[0]
    assert [i.field for i in report.categories[0].issues if i.code == "not_in_text"] == ["c"]


def test_vendor_lengths(spark):
    names = ["X", "XY", "v" * 100, "v" * 101, " X ", "", 5]
    reports = validated(spark, [{"vendor_name": n} for n in names])
    found = [[c for c in codes(r, "business_rules")] for r in reports]
    assert found == [["vendor_too_short"], [], [], ["vendor_too_long"], ["vendor_too_short"], [], ["check_failed"]]
    assert reports[6].categories[2].points == 80


def test_amount_ranges_and_tax_rate(spark):
    reports = validated(
        spark,
        [{"amount": "1000000"}, {"amount": "1,000,000.01"}, {"total_amount_numeric": 2000000}, {"tax_amount": "50", "subtotal": "100"},
         {"tax_amount": "50.01", "subtotal": "100"}, {"tax_amount": "5", "subtotal": "0"}],
    )
    found = [codes(r, "business_rules") for r in reports]
    assert found == [[], ["amount_too_large"], ["amount_too_large"], [], ["tax_rate_unreasonable"], []]


@pytest.mark.parametrize(
    "record, text, wanted, missing",
    [
        ({"invoice_number": "12345678"}, "", 4, 3),
        ({"parties": [], "contract_date": "1/1/2024"}, "", 3, 2),
        ({"x": "yy"}, "application", 1, 1),
        ({"executive_summary": "fine"}, "a report", 2, 1),
        ({"summary": "fine"}, "words", 1, 0),
        ({"summary": None}, "words", 1, 1),
        ({"summary": 0}, "words", 1, 1),
    ],
)
def test_required_fields(spark, record, text, wanted, missing):
    report = validated(spark, [record], {0: text}, validation_type="completeness")[0]
    assert (len(report.required_fields), len(report.missing_fields)) == (wanted, missing)
    percent = (len(record) - missing) / wanted * 100
    assert report.completeness_percentage == pytest.approx(percent)
    assert report.overall_score == pytest.approx(max(0, 1 - 0.15 * missing))


def test_percentage_above_hundred_and_weak_fields(spark):
    report = validated(spark, [{"summary": "fine", "a": "b", "c": 1}], validation_type="completeness")[0]
    assert report.completeness_percentage == 300 and report.low_quality_fields == ["a"]
    assert report.categories[0].status == "passed" and report.overall_score == 0.9


def test_score_threshold_is_exact(spark):
    three = {f"f{i}": f"value{i}" for i in range(3)}
    four = {f"f{i}": f"value{i}" for i in range(4)}
    reports = validated(spark, [three, four], validation_type="consistency")
    assert [(r.overall_score, r.is_valid) for r in reports] == [(0.7, True), (0.6, False)]


def test_unknown_type_and_empty_data(spark):
    assert validated(spark, [{"a": "text"}], validation_type="other")[0].overall_score == 0.0
    empty = validated(spark, [{}])[0]
    assert empty.error and empty.overall_score == 0.0 and not empty.is_valid and empty.categories == []


def test_recommendations_in_order(spark):
    report = validated(spark, [{"email": "bad", "vendor_name": "X"}])[0]
    assert [r.split()[0] for r in report.recommendations] == ["Review", "Correct", "Verify", "Complete"]


def test_ocr_comparison_only_on_request(spark):
    fields = "map('a', named_struct('kind', 'string', 'value', 'Hello', 'filled', true))"
    frame = spark.sql(f"SELECT 1 AS doc_id, {fields} AS fields, cast(NULL AS decimal(30,6)) AS items_total, 'hello' AS text, 'HELL' AS ocr")
    off = validation.validate(frame, TODAY).first().validation
    on = validation.validate(frame, TODAY, ocr_text="ocr").first().validation
    assert [c.category for c in off.categories] == validation.fixed.CHECK_CATEGORIES
    assert on.categories[-1].category == "ocr_consistency" and on.categories[-1].points == 90


def test_scores_stay_in_range(spark):
    worst = {f"date_email_phone_amount_{i}": "?" for i in range(30)}
    report = validated(spark, [worst])[0]
    assert all(0 <= c.points <= 100 for c in report.categories) and 0 <= report.overall_score <= 1
    assert report.categories[1].points == 0


def test_quality_levels_and_advice(spark):
    rows = [(0.9, 0.9, 0.9, True), (0.8, 0.8, 0.8, True), (0.7, 0.7, 0.7, False), (0.69, 0.69, 0.69, True)]
    frame = spark.createDataFrame(rows, "o double, a double, v double, ok boolean")
    metric = results.quality_metrics(F.col("o"), F.col("a"), F.col("v"), F.col("ok"))
    found = [r.q for r in frame.select(metric.alias("q")).collect()]
    assert [q.quality_level for q in found] == ["excellent", "good", "fair", "poor"]
    assert [len(q.recommendations) for q in found] == [1, 0, 2, 2]
    assert found[2].reliability_score == pytest.approx(0.35)


def test_later_filters_do_not_multiply_the_plan(spark):
    frame = spark.createDataFrame([(1, '{"summary":"x"}', "x", "auto")], "doc_id int, response string, text string, requested_type string")
    done = validation.validate(analysis.analyze(frame), TODAY)
    plain = done._jdf.queryExecution().optimizedPlan().toString()
    picked = done.where("validation.is_valid AND analysis.confidence_score > 0.1")
    assert len(picked._jdf.queryExecution().optimizedPlan().toString()) < 1.3 * len(plain)
