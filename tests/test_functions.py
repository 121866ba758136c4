"""Hand-worked values of the row expressions."""

import datetime as dt
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from paperlane.functions import entities, fixed, jsontext, prompts, text, values
from paperlane.operators import validation


def evaluate(spark, inputs, *expressions):
    """Rows of expression results for string inputs `x`, in input order."""
    rows = [(i, x) for i, x in enumerate(inputs)]
    frame = spark.createDataFrame(rows, "i int, x string")
    out = frame.selectExpr("i", *[f"{e} AS e{n}" for n, e in enumerate(expressions)]).collect()
    results = [tuple(r)[1:] for r in sorted(out, key=lambda r: r.i)]
    return [r[0] for r in results] if len(expressions) == 1 else results


DATES = {
    "24/01/15": "2015-01-24",
    "13/06/2024": "2024-06-13",
    "06/13/2024": "2024-06-13",
    "1/2/69": "1969-01-02",
    "1/2/68": "2068-01-02",
    "02/30/2024": None,
    "31/12/99": "1999-12-31",
    "70/02/28": "1970-02-28",
    "2024-1-5": "2024-01-05",
    "2024/1/5": "2024-01-05",
    " 01-02-2024 ": "2024-01-02",
    "01-02/2024": None,
    "01-02-24": None,
    "0000-01-01": None,
    "2024": None,
    "soon": None,
    "": None,
    "29/2/72": "1972-02-29",
    "1/1/5": None,
}


def test_dates(spark):
    found = evaluate(spark, DATES, values.parse_date("x"))
    assert [None if d is None else d.isoformat() for d in found] == list(DATES.values())


def reference_date(raw):
    for layout in ["%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y", "%Y-%m-%d", "%m/%d/%y", "%d/%m/%y", "%y/%m/%d"]:
        try:
            return dt.datetime.strptime(raw.strip(), layout).date()
        except ValueError:
            pass
    return None


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.from_regex(r"\A[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}\Z"), min_size=200, max_size=200))
def test_dates_like_strptime(spark, raw):
    assert evaluate(spark, raw, values.parse_date("x")) == [reference_date(r) for r in raw]


def test_amounts(spark):
    given_amounts = {"$1,234.50": 1234.5, "1.2.3": 0.0, "": 0.0, "-5": 5.0, ".": 0.0, "5.": 5.0, "1e3": 13.0, "none": 0.0}
    assert evaluate(spark, given_amounts, values.numeric_amount("x")) == list(given_amounts.values())
    assert [float(v) for v in evaluate(spark, given_amounts, values.money("x"))] == list(given_amounts.values())


@pytest.mark.parametrize(
    "rule, good, bad",
    [
        ("email", ["a.b+c@x-y.co"], ["bad@", "a@b.c", "a b@c.de"]),
        ("phone", ["+1 (555) 010-0042", "5555555555"], ["555-01", "1" * 16, "12345 abcde"]),
        ("date", ["1/2/24", "2024-01-05", "5 Jan 2024"], ["soon", "5 jan 2024", "1.2.2024"]),
        ("amount", ["$1,234.50", "12", "1234.50"], ["1,23", "$ 5", "1.5", ""]),
        ("invoice_number", ["inv00000001", "12345678", "A12B3456"], ["N-41", "INVX", "1234567"]),
        ("tax_id", ["12-3456789", "123456789"], ["T7", "1234567890"]),
    ],
)
def test_formats(spark, rule, good, bad):
    assert evaluate(spark, good + bad, values.FORMAT_TESTS[rule]("x")) == [True] * len(good) + [False] * len(bad)


SAMPLES = ["", "one", " a\x1cb c d ", "x\n\ny", "tail\n", "é ñ　日本 語", "a\tb\x0bc\x85d​e"]


def test_text_stats_like_python(spark):
    found = evaluate(spark, SAMPLES, text.text_stats("x"))
    assert [tuple(s) for s in found] == [(len(x), len(x.split()), len(x.split("\n"))) for x in SAMPLES]
    assert evaluate(spark, SAMPLES, text.strip("x")) == [x.strip() for x in SAMPLES]


def test_document_type_ties_and_defaults(spark):
    inputs = ["", None, "invoice contract", "agreement and contract, bill", "information", "Dear reader", "nothing here"]
    expected = ["general", "general", "invoice", "contract", "form", "correspondence", "general"]
    assert evaluate(spark, inputs, text.detect_document_type("x")) == expected
    assert evaluate(spark, ["information"], text.detect_document_type("x", whole_word=True)) == ["general"]


def test_category_and_validation_type(spark):
    inputs = ["A notice of agreement", "notice", "legal lawsuit", "xyz"]
    assert evaluate(spark, inputs, text.categorize_document("x")) == ["contract", "correspondence", "legal", "general"]
    kinds = text.detect_validation_type("array('parties')", "x"), text.detect_validation_type("array('a')", "x")
    assert evaluate(spark, ["a bill", "application"], *kinds) == [("contract", "invoice"), ("contract", "form")]


def test_elements(spark):
    cases = {
        "A" * 99: "heading",
        "A" * 100: "text",
        "a1" * 24 + "b": "title",
        "a1" * 25: "text",
        "x." * 100: "text",
        "x." * 100 + "y": "paragraph",
        "a.\nb": "paragraph",
        "TOTAL 12": "heading",
        "12": "title",
        "": "text",
        "Ünï çode": "title",
    }
    assert evaluate(spark, cases, text.classify_element("x")) == list(cases.values())


def test_key_points_and_summary(spark):
    body = "\n".join(["- short", "  - a point that is long enough ", "• another point, quite long", "this is Important to everyone", "plain line that is long enough"])
    assert evaluate(spark, [body], text.key_points("x")) == [
        ["a point that is long enough", "another point, quite long", "this is Important to everyone"]
    ]
    assert evaluate(spark, ["abcd", "abc"], text.summarize_truncate("x", 3)) == ["abc...", "abc"]


def test_entities_like_findall(spark):
    inputs = ["pay $ 1,200.50 to a.b@c.org by 1/2/24", "no", "12,345 and 7.25, x@y|z.co"]
    for row, raw in zip(evaluate(spark, inputs, entities.extract_entities("x")), inputs):
        assert row["emails"] == re.findall(fixed.EMAIL_IN_TEXT, raw)
        assert row["amounts"] == re.findall(fixed.AMOUNT_IN_TEXT, raw)
        assert row["dates"] == re.findall(fixed.DATE_IN_TEXT, raw)
        assert row["people"] == row["urls"] == []


STRICT = {
    ' {"a": 1} ': True,
    '{"a":1} and {"b":2}': False,
    '{"a":1},{"b":2}': False,
    '{"a":1}],[{"b":2}': False,
    "[1,2]": False,
    "": False,
    None: False,
    '{"a":': False,
    '{"a":1},"end-of-response"],[1': False,
}


def test_strict_json(spark):
    found = evaluate(spark, STRICT, f"{jsontext.strict_object('x')} IS NOT NULL")
    assert found[:-1] == list(STRICT.values())[:-1]
    spans = evaluate(spark, ['see {"a": {"b": 2}} end', "} {", "x"], f"string({jsontext.span_object('x')})")
    assert spans == ['{"a":{"b":2}}', None, None]


def test_fields_keep_presence_kind_and_emptiness(spark):
    raw = '{"s":"x","e":"","n":0,"f":1.5,"z":null,"t":false,"l":[],"m":[1],"o":{},"_p":1}'
    found = evaluate(spark, [raw], jsontext.drop_private_keys(jsontext.fields_of(jsontext.strict_object("x"))))[0]
    assert {k: (v.kind, v.filled) for k, v in found.items()} == {
        "s": ("string", True), "e": ("string", False), "n": ("number", False), "f": ("number", True),
        "z": ("null", False), "t": ("boolean", False), "l": ("array", False), "m": ("array", True), "o": ("object", False),
    }


def test_private_keys_at_any_depth(spark):
    cases = {
        '{"a":[{"_x":1,"b":{"_y":2,"c":"é"}}],"_z":0}': '{"a":[{"b":{"c":"é"}}]}',
        '{"_a": {"x": [1, {"_b": "}"}]}, "k" : 1.50, "_l": null }': '{"k" : 1.50}',
        '{"_only":[[],{}]}': "{}",
        '[{"_a":1},{"_a":1,"b":2},{"b":2,"_a":1,"_c":"],"}]': '[{},{"b":2},{"b":2}]',
        '{"u":"say \\"_x\\": 1","\\u005fp":{"q":1},"v":"_no key"}': '{"u":"say \\"_x\\": 1","v":"_no key"}',
        '{"d":{"d":{"d":{"d":{"_e":1,"f":12345678901234567890123.0}}}}}': '{"d":{"d":{"d":{"d":{"f":12345678901234567890123.0}}}}}',
        '{"_a":1} and more': '{"_a":1} and more',
        '{"_a":1': '{"_a":1',
        '{"keep":  [1, 2]}': '{"keep":  [1, 2]}',
        "no json": "no json",
        None: None,
    }
    assert evaluate(spark, list(cases), jsontext.drop_private_nested("x")) == list(cases.values())
    deep = '{"a":' * 300 + '{"_p":[1],"z":2}' + "}" * 300
    assert evaluate(spark, [deep], jsontext.drop_private_nested("x")) == [deep.replace('"_p":[1],', "")]
    kept = evaluate(spark, ['{"a":{"_b":1,"c":2}}', '{"_a":oops}', '{"c":1}'], f"string({jsontext.public_object('x')})")
    assert kept == ['{"a":{"c":2}}', None, '{"c":1}']


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text("_ab\\\"},", max_size=3), v, max_size=3), max_leaves=12), min_size=20, max_size=20))
def test_private_keys_like_a_parser(spark, values_of):
    def without(node):
        if isinstance(node, dict):
            return {k: without(v) for k, v in node.items() if not k.startswith("_")}
        return [without(v) for v in node] if isinstance(node, list) else node

    raws = [json.dumps({"k": v}) for v in values_of]
    found = evaluate(spark, raws, jsontext.drop_private_nested("x"))
    assert [json.loads(f) for f in found] == [without(json.loads(r)) for r in raws]


def test_exponents_are_written_out(spark):
    cases = {"1.5e7": "15000000", "1.5E7": "15000000", "12.345e1": "123.45", "5e-3": "0.005", "1e2": "100", "-2.5E+3": "-2500", "1E0": "1", "12": "12", "1.0E30": "1" + "0" * 30, "text e": "text e", "1e999999999999": "1" + "0" * 400}
    assert evaluate(spark, list(cases), values.plain_number("x")) == list(cases.values())
    raw = '{"total_amount":1.5e7,"tax_amount":2.5E-1,"subtotal":"1.5e7"}'
    found = evaluate(spark, [raw], jsontext.fields_of(jsontext.strict_object("x")))[0]
    assert {k: v.value for k, v in found.items()} == {"total_amount": "15000000", "tax_amount": "0.25", "subtotal": "1.5e7"}


def test_long_amounts_compare_exactly(spark):
    longest = "9" * 30
    raws = [longest, longest[:-1] + "8", "1" + "0" * 30, "0" * 40 + "5", "$1,0.1.2", "7" * 30 + ".12345678"]
    found = evaluate(spark, raws, values.money_or_null("x"))
    assert found[0] - found[1] == 1 and found[2] is None and found[3] == 5 and found[4] == 0 and str(found[5]).endswith(".12345678")
    assert evaluate(spark, raws, values.money_too_large("x")) == [False, False, True, False, False, False]


def test_rules_read_exponents_and_long_amounts(spark):
    rows = [
        '{"subtotal":1.4e7,"tax_amount":1e6,"total_amount":"15000000.00"}',
        '{"subtotal":1.4e7,"tax_amount":1e6,"total_amount":"15000000.02"}',
        '{"items":[{"total_price":1.5e2},{"total_price":"50"}],"total_amount":200}',
        '{"items":[{"total_price":1.5e2},{"total_price":"50"}],"total_amount":2.01e2}',
        '{"subtotal":"%s","tax_amount":"1","total_amount":"1%s"}' % ("9" * 29, "0" * 29),
        '{"subtotal":"%s","tax_amount":"2","total_amount":"1%s"}' % ("9" * 29, "0" * 29),
        '{"subtotal":1e40,"tax_amount":0,"total_amount":1e40}',
        '{"items":[{"total_price":"%s"},{"total_price":"%s"}],"total_amount":1}' % ("9" * 30, "9" * 30),
        '{"subtotal":1e1,"tax_amount":0.6E1,"total_amount":1.6e1}',
    ]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id int, x string")
    docs = frame.selectExpr("doc_id", "x", f"{jsontext.strict_object('x')} AS o").selectExpr(
        "doc_id", "x AS text", f"{jsontext.fields_of('o')} AS fields", f"{jsontext.items_total('o', values.money_or_null)} AS items_total"
    )
    done = validation.validate(docs, dt.date(2000, 1, 1))
    codes = {r.doc_id: {i.code for c in r.validation.categories for i in c.issues} & {"tax_sum_mismatch", "items_total_mismatch", "amount_not_comparable", "amount_too_large", "tax_rate_unreasonable"} for r in done.collect()}
    assert codes == {
        0: {"amount_too_large"}, 1: {"tax_sum_mismatch", "amount_too_large"}, 2: set(), 3: {"items_total_mismatch"}, 4: {"amount_too_large"},
        5: {"tax_sum_mismatch", "amount_too_large"}, 6: {"amount_not_comparable", "amount_too_large"}, 7: {"amount_not_comparable"}, 8: {"tax_rate_unreasonable"},
    }


def test_items_total(spark):
    raws = ['{"items":[{"total_price":"$1.50"},{"total_price":2},{"x":1},3]}', '{"items":[]}', '{"items":"x"}', "{}"]
    found = evaluate(spark, raws, jsontext.items_total(jsontext.strict_object("x"), values.money))
    assert [None if v is None else float(v) for v in found] == [3.5, 0.0, None, None]


def test_prompts(spark):
    long = "y" * 5000
    full, brief = evaluate(spark, [long], prompts.prompt("'entities'", "x"), prompts.brief_prompt("'unknown'", "x"))[0]
    assert full.count("y" * 2000) == 1 and "y" * 2001 not in full
    assert "y" * 3000 in brief and "y" * 3001 not in brief
    whole = evaluate(spark, [long], prompts.prompt("'invoice'", "x"))[0]
    assert whole.endswith(long) and "vendor_name" in whole
    checked = evaluate(spark, ["{}"], prompts.validation_prompt("x", "'rules'"))[0]
    assert "Information: {}" in checked and checked.endswith("Rules: rules")
    sent = evaluate(spark, ["q"], prompts.request("'summary'", "x", "m", "be brief"))[0]
    assert [m.role for m in sent.messages] == ["system", "user"] and sent.max_tokens == 300
