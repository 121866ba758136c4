"""Every operator as a query over the warehouse tables.

Each function takes the session and the folder of parquet files. Outputs are
flat: numbers, strings and flags, doubles rounded to six places, lists joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import entities, jsontext, prompts, text as texts, values
from ..functions.sql import array, listed
from ..operators import admission, analysis, layout, metrics, results, userfn, validation as rules
from ..sources import readers, versions, writers
from ..streaming import pages as streams
from . import documents as docs
from .batch import process_batch, process_documents
from .documents import AS_OF
from .views import view

DAY = f"DATE '{AS_OF.isoformat()}'"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rounded(*names: str) -> list[str]:
    return [f"round({n}, 6) AS {n.split('.')[-1]}" for n in names]


def _joined(expression: str, name: str) -> str:
    return f"array_join({expression}, '|') AS {name}"


# --- sources -----------------------------------------------------------------


@query
def s1_document_catalog(spark, sf_dir):
    return readers.document_catalog(spark, sf_dir).select("filename", "size_bytes", "size_mb", "extension", "supported")


@query
def s2_text_items(spark, sf_dir):
    return readers.text_items(base(spark, sf_dir, "documents"))


@query
def s3_normalize_ocr(spark, sf_dir):
    # Raw recogniser lines: each line of a document with the four corners of its box.
    x = "cast((doc_id * 7 + i * 13) % 600 AS double)"
    y = "cast((i % 40) * 25 + IF((doc_id + i) % 4 = 0, 40, 0) AS double)"
    wide = "10 * length(t)"
    corners = f"array(array({x}, {y}), array({x} + {wide}, {y}), array({x} + {wide}, {y} + 20), array({x}, {y} + 20))"
    line = f"named_struct('poly', {corners}, 'text', t, 'confidence', cast(50 + (doc_id * 31 + i * 17) % 50 AS double) / 100D)"
    raw = base(spark, sf_dir, "documents").selectExpr("doc_id", f"transform(split(text, '\\n'), (t, i) -> {line}) AS lines")
    return readers.normalize_ocr(raw)


@query
def s4_chat_contents(spark, sf_dir):
    body = view(spark, sf_dir, "llm_responses").selectExpr(
        "doc_id",
        "IF(doc_id % 7 = 0, 500, 200) AS status",
        "to_json(named_struct('choices', IF(doc_id % 6 = 5, array(), array(named_struct('message', "
        "named_struct('role', 'assistant', 'content', concat('  ', response, '\\n'))))))) AS body",
    )
    parsed = body.selectExpr(
        "doc_id", "status",
        "from_json(body, 'choices array<struct<message:struct<role:string,content:string>>>').choices AS choices",
    )
    return readers.chat_contents(parsed)


# --- admission ---------------------------------------------------------------


def _files(spark, sf_dir):
    return base(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "n_chars * 20000 AS size_bytes",
        "CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' WHEN 3 THEN '.tiff' ELSE '.txt' END AS extension",
    )


@query
def f1_admit(spark, sf_dir):
    accepted, rejected = admission.admit(_files(spark, sf_dir))
    return accepted.withColumn("reason", F.lit("accepted")).unionByName(rejected)


@query
def f2_filter_confidence(spark, sf_dir):
    return layout.filter_confidence(view(spark, sf_dir, "ocr_tokens")).select("doc_id", "pos", "page", "confidence")


@query
def f3_require_input(spark, sf_dir):
    tasks = view(spark, sf_dir, "llm_responses").selectExpr(
        "doc_id", "IF(doc_id % 7 = 0, NULL, 'document_analysis') AS type", "response AS extracted_text"
    )
    checked = admission.require_input(tasks, "analysis")
    return checked.selectExpr("doc_id", "error IS NULL AS accepted", "coalesce(error.message, '') AS message")


@query
def f4_branches(spark, sf_dir):
    kinds = "CASE doc_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'structure' WHEN 3 THEN 'full' ELSE 'other' END"
    checks = (
        "CASE doc_id % 6 WHEN 0 THEN 'comprehensive' WHEN 1 THEN 'consistency' WHEN 2 THEN 'format' "
        "WHEN 3 THEN 'business_rules' WHEN 4 THEN 'completeness' ELSE 'other' END"
    )
    asked = base(spark, sf_dir, "documents").selectExpr("doc_id", f"{kinds} AS kind", f"{checks} AS checks")
    return asked.selectExpr(
        "doc_id",
        f"{admission.extraction_branch('kind')} AS branch",
        _joined(rules.categories_of("checks"), "categories"),
    )


# --- layout ------------------------------------------------------------------


@query
def l1_assemble_text(spark, sf_dir):
    return layout.assemble_text(docs.page_tokens(spark, sf_dir)).selectExpr(
        "doc_id", "extracted_content", "total_items", "filtered_items", "pages_processed",
        *_rounded("confidence", "processing_time"),
    )


@query
def l2_stamp_page(spark, sf_dir):
    paged = base(spark, sf_dir, "documents").selectExpr("doc_id", "split(text, '\\n\\n') AS pages")
    return layout.stamp_page(paged).selectExpr("doc_id", "page", "length(page_content) AS chars")


@query
def l3_segment_tables(spark, sf_dir):
    return layout.segment_tables(view(spark, sf_dir, "ocr_tokens")).select("doc_id", "page", "pos", "table_no")


@query
def l4_group_rows(spark, sf_dir):
    cells = layout.group_rows(view(spark, sf_dir, "ocr_tokens"))
    return cells.select("doc_id", "page", "pos", "table_no", "row_no", "col_no")


@query
def l5_render_tables(spark, sf_dir):
    return layout.table_result(view(spark, sf_dir, "ocr_tokens")).select("doc_id", "extracted_content")


@query
def l6_table_result(spark, sf_dir):
    return layout.table_result(docs.page_tokens(spark, sf_dir)).selectExpr(
        "doc_id", "extracted_content", "total_tables", "pages_processed", *_rounded("confidence", "processing_time"),
        "extraction_type",
    )


@query
def l7_classify_element(spark, sf_dir):
    return layout.structure_elements(view(spark, sf_dir, "ocr_tokens")).select("doc_id", "pos", "element_type")


@query
def l8_structure_result(spark, sf_dir):
    return layout.structure_result(docs.page_tokens(spark, sf_dir)).selectExpr(
        "doc_id", "extracted_content", "total_elements", "headings", "titles", "paragraphs", "texts",
        "pages_processed", *_rounded("confidence", "processing_time"), "extraction_type",
    )


@query
def l9_full_content(spark, sf_dir):
    return layout.full_content(docs.page_tokens(spark, sf_dir)).selectExpr(
        "doc_id", "extracted_content", "total_elements", "pages_processed", *_rounded("confidence", "processing_time"),
        "extraction_type", "table_extraction.extracted_content AS table_content", "table_extraction.total_tables",
        "structure_extraction.extracted_content AS structure_content", "structure_extraction.total_elements AS elements",
        "structure_extraction.headings", "structure_extraction.titles", "structure_extraction.paragraphs",
        "structure_extraction.texts", "text_extraction.total_items", "text_extraction.filtered_items",
        "round(text_extraction.confidence, 6) AS text_confidence",
        "round(structure_extraction.confidence, 6) AS structure_confidence",
    )


@query
def l10_extraction_confidence(spark, sf_dir):
    text = layout.assemble_text(docs.page_tokens(spark, sf_dir))
    mean = "IF(filtered_items > 0, confidence, NULL)"
    stated = "IF(doc_id % 3 = 0, NULL, cast(0.5 AS double))"
    return text.selectExpr("doc_id", f"round({layout.overall_extraction_confidence(mean, stated)}, 6) AS confidence")


# --- classification ----------------------------------------------------------


@query
def c1_text_stats(spark, sf_dir):
    return base(spark, sf_dir, "documents").selectExpr("doc_id", f"{texts.text_stats('text')} AS s").select("doc_id", "s.*")


@query
def c2_detect_document_type(spark, sf_dir):
    typed = view(spark, sf_dir, "typed_docs").withColumn("lowered", F.lower("text"))
    return typed.selectExpr("doc_id", f"{texts.detect_document_type('text', lowered='lowered')} AS document_type")


@query
def c3_categorize_document(spark, sf_dir):
    typed = view(spark, sf_dir, "typed_docs").withColumn("lowered", F.lower("text"))
    return typed.selectExpr("doc_id", f"{texts.categorize_document('text', 'lowered')} AS category")


@query
def c4_detect_validation_type(spark, sf_dir):
    named = "CASE doc_id % 4 WHEN 0 THEN array('total_amount', 'x') WHEN 1 THEN array('parties') ELSE array('x') END"
    typed = view(spark, sf_dir, "typed_docs").selectExpr("doc_id", "text", "lower(text) AS lowered", f"{named} AS names")
    return typed.selectExpr("doc_id", f"{texts.detect_validation_type('names', 'text', 'lowered')} AS validation_type")


@query
def c5_route_analysis(spark, sf_dir):
    asked = "CASE doc_id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'legal' ELSE 'auto' END"
    typed = view(spark, sf_dir, "typed_docs").selectExpr("doc_id", "text", "lower(text) AS lowered", f"{asked} AS asked")
    routed = typed.selectExpr("doc_id", f"{texts.route_analysis('asked', 'text', 'lowered')} AS analysis_type")
    return routed.selectExpr("doc_id", "analysis_type", f"{texts.analysis_branch('analysis_type')} AS branch")


@query
def c6_build_prompts(spark, sf_dir):
    kinds = array(["general", "invoice", "contract", "form", "report", "entities", "summary", "other"])
    asked = view(spark, sf_dir, "typed_docs").selectExpr("doc_id", "text", f"explode({kinds}) AS kind")
    written = asked.selectExpr(
        "doc_id", "kind", f"{prompts.prompt('kind', 'text')} AS full", f"{prompts.brief_prompt('kind', 'text')} AS brief"
    )
    sent = written.withColumn("r", F.expr(prompts.request("kind", "full", "model", "Answer in JSON.")))
    return sent.selectExpr(
        "doc_id", "kind", "length(full) AS full_chars", "md5(full) AS full_md5", "length(brief) AS brief_chars",
        "md5(brief) AS brief_md5", "r.temperature AS temperature", "r.max_tokens AS max_tokens",
        "size(r.messages) AS messages",
    )


# --- extraction --------------------------------------------------------------


@query
def x1_parse_response_strict(spark, sf_dir):
    parsed = view(spark, sf_dir, "llm_responses").withColumn(
        "record", F.expr(analysis.parse_response_strict("response", "'invoice'"))
    )
    get = lambda n, t: f"try_variant_get(record, '$.{n}', '{t}') AS {n}"
    return parsed.selectExpr(
        "doc_id", get("vendor_name", "string"), get("invoice_date", "string"), get("total_amount", "string"),
        get("confidence", "double"),
    )


@query
def x2_parse_response_span(spark, sf_dir):
    asked = view(spark, sf_dir, "llm_responses").withColumn("kind", F.lit("invoice"))
    return analysis.parse_response_span(asked).selectExpr(
        "doc_id", "parsed IS NOT NULL AS is_json", "try_variant_get(parsed, '$.total_amount', 'string') AS total_amount",
        "document_type", "summary", "confidence", "coalesce(array_join(entities['amounts'], '|'), '') AS amounts",
        "raw_analysis",
    )


@query
def x3_fallback_general(spark, sf_dir):
    r = view(spark, sf_dir, "llm_responses").selectExpr("doc_id", f"{analysis.fallback_general('response')} AS r")
    return r.selectExpr(
        "doc_id", "r.document_type", "r.sentiment", "r.urgency_level", "r.summary", "r.confidence",
        "size(r.main_topics) + size(r.action_items) + size(r.key_entities.dates) AS listed",
    )


@query
def x4_fallback_invoice(spark, sf_dir):
    texts_of = docs.answered_documents(spark, sf_dir).selectExpr("doc_id", "concat(response, '\\n', text) AS response")
    r = texts_of.selectExpr("doc_id", f"{analysis.fallback_invoice('response')} AS r")
    return r.selectExpr(
        "doc_id", "r.invoice_date", "r.total_amount", "r.vendor_name", "size(r.items) AS items", "r.confidence"
    )


def _fixed_record(spark, sf_dir, branch):
    """The record of a branch for every response: its own JSON where it is some, else the fixed shape."""
    record = analysis.parse_response_strict("response", f"'{branch}'")
    found = view(spark, sf_dir, "llm_responses").selectExpr("doc_id", f"{record} AS v")
    return found.selectExpr("doc_id", f"{jsontext.fields_of('v')} AS f")


@query
def x5_fallback_contract(spark, sf_dir):
    f = _fixed_record(spark, sf_dir, "contract")
    return f.selectExpr(
        "doc_id", "f['parties'].value AS parties", "f['contract_date'].value AS contract_date",
        "f['obligations'].kind AS obligations_kind", "cast(f['confidence'].value AS double) AS confidence",
        "size(f) AS fields",
    )


@query
def x6_fallback_form(spark, sf_dir):
    f = _fixed_record(spark, sf_dir, "form")
    return f.selectExpr(
        "doc_id", "f['form_type'].value AS form_type", "cast(f['total_fields'].value AS int) AS total_fields",
        "f['form_fields'].kind AS form_fields_kind", "cast(f['confidence'].value AS double) AS confidence",
        "size(f) AS fields",
    )


@query
def x7_fallback_report(spark, sf_dir):
    f = _fixed_record(spark, sf_dir, "report")
    return f.selectExpr(
        "doc_id", "f['report_type'].value AS report_type", "f['executive_summary'].value AS executive_summary",
        "f['data_points'].kind AS data_points_kind", "cast(f['confidence'].value AS double) AS confidence",
        "size(f) AS fields",
    )


@query
def x8_extract_error_record(spark, sf_dir):
    asked = docs.answered_documents(spark, sf_dir).selectExpr(
        "doc_id", "IF(doc_id % 5 = 0, '', text) AS text", "IF(doc_id % 7 = 0, NULL, response) AS response", "requested_type"
    )
    done = analysis.analyze(asked)
    return done.selectExpr(
        "doc_id", "coalesce(analysis.error, '') AS error",
        "coalesce(try_variant_get(analysis.detailed_analysis, '$.error', 'string'), '') AS record_error",
        "analysis.confidence_score AS confidence", "coalesce(size(fields), 0) AS fields",
    )


@query
def x9_extract_entities(spark, sf_dir):
    both = view(spark, sf_dir, "typed_docs").unionByName(
        view(spark, sf_dir, "invoice_texts").selectExpr("doc_id + 1000000 AS doc_id", "text")
    )
    found = both.selectExpr("doc_id", f"{entities.extract_entities('text')} AS e")
    return found.selectExpr("doc_id", *[_joined(f"e['{k}']", k) for k in entities.KINDS])


@query
def x10_extract_key_points(spark, sf_dir):
    both = view(spark, sf_dir, "typed_docs").unionByName(
        view(spark, sf_dir, "invoice_texts").selectExpr("doc_id + 1000000 AS doc_id", "text")
    )
    return both.selectExpr("doc_id", _joined(texts.key_points("text"), "key_points"))


@query
def x11_extract_numeric_amount(spark, sf_dir):
    return view(spark, sf_dir, "invoices").selectExpr(
        "doc_id", f"{values.numeric_amount('total_amount')} AS total", f"{values.numeric_amount('invoice_date')} AS odd"
    )


@query
def x12_total_amount_numeric(spark, sf_dir):
    parsed = view(spark, sf_dir, "llm_responses").withColumn(
        "_record", F.expr(analysis.parse_response_strict("response", "'invoice'"))
    )
    return analysis.with_fields(parsed, "'invoice'").selectExpr(
        "doc_id", "cast(fields['total_amount_numeric'].value AS double) AS total_amount_numeric", "size(fields) AS n_fields"
    )


@query
def x13_parse_date_multi(spark, sf_dir):
    return view(spark, sf_dir, "invoices").selectExpr(
        "doc_id", "invoice_date", f"cast({values.parse_date('invoice_date')} AS string) AS invoice_day",
        f"cast({values.parse_date('due_date')} AS string) AS due_day",
    )


@query
def x14_summarize_truncate(spark, sf_dir):
    return view(spark, sf_dir, "typed_docs").selectExpr("doc_id", f"{texts.summarize_truncate('text')} AS summary")


@query
def x15_parse_verdict(spark, sf_dir):
    judged = (
        "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN "
        "'{\"is_valid\": true, \"confidence\": 0.4, \"issues\": [\"a\", \"b\"], \"suggestions\": []}' "
        "WHEN 2 THEN 'this is invalid' WHEN 3 THEN 'Correct.' ELSE response END"
    )
    asked = view(spark, sf_dir, "llm_responses").selectExpr("doc_id", f"{judged} AS verdict")
    return asked.selectExpr("doc_id", f"{analysis.parse_verdict('verdict')} AS v").selectExpr(
        "doc_id", "v.is_valid", "v.confidence", _joined("v.issues", "issues"), _joined("v.suggestions", "suggestions")
    )


@query
def x16_drop_private_keys(spark, sf_dir):
    objects = view(spark, sf_dir, "llm_responses").withColumn("o", F.expr(jsontext.strict_object("response")))
    found = objects.selectExpr("doc_id", f"{jsontext.fields_of('o')} AS f")
    clean = found.selectExpr("doc_id", "coalesce(size(f), 0) AS before", f"{jsontext.drop_private_keys('f')} AS f")
    return clean.selectExpr("doc_id", "before", "coalesce(array_join(array_sort(map_keys(f)), '|'), '') AS names")


@query
def x16_drop_private_nested(spark, sf_dir):
    nested = view(spark, sf_dir, "invoices").selectExpr(
        "doc_id",
        "to_json(named_struct('keep', named_struct('_a', 1, 'b', array(named_struct('_c', 2, 'd', invoice_number))), '_x', 0)) AS raw",
    ).selectExpr("doc_id", "IF(doc_id % 4 = 0, concat(raw, ' and more'), raw) AS raw")
    return nested.selectExpr("doc_id", f"{jsontext.drop_private_nested('raw')} AS clean")


@query
def x17_assemble_analysis(spark, sf_dir):
    return analysis.analyze(docs.answered_documents(spark, sf_dir)).selectExpr(
        "doc_id", "analysis.analysis_type", "analysis.category", "analysis.summary",
        _joined("analysis.entities['amounts']", "amounts"), _joined("analysis.entities['emails']", "emails"),
        "analysis.confidence_score", "analysis.text_stats.*", "size(fields) AS n_fields",
    )


# --- validation --------------------------------------------------------------


def _invoices(spark, sf_dir):
    return rules.prepare(docs.invoice_documents(spark, sf_dir))


def _contacts(spark, sf_dir):
    return rules.prepare(docs.contact_documents(spark, sf_dir).withColumn("text", F.lit("")))


def _issues(prepared: DataFrame, issues: str) -> DataFrame:
    found = prepared.selectExpr("doc_id", f"explode({issues}) AS i")
    return found.selectExpr("doc_id", "i.code", "i.field", "coalesce(i.observed, '') AS observed")


@query
def v1_field_dispatch(spark, sf_dir):
    both = _invoices(spark, sf_dir).select("doc_id", "_e").unionByName(
        _contacts(spark, sf_dir).selectExpr("doc_id + 1000000 AS doc_id", "_e")
    )
    return both.selectExpr("doc_id", f"explode({rules.format_tests()}) AS t").select("doc_id", "t.*")


def _format_query(name: str, rule: str, column: str, source: str):
    def run(spark, sf_dir):
        test = values.FORMAT_TESTS[rule]
        rows = view(spark, sf_dir, source).where(f"{column} IS NOT NULL")
        return rows.selectExpr("doc_id", f"{column} AS value", f"{test(column)} AS ok")

    run.__name__ = name
    query(run)


_format_query("v2_valid_email", "email", "contact_email", "vendor_contacts")
_format_query("v3_valid_phone", "phone", "contact_phone", "vendor_contacts")
_format_query("v4_valid_date_format", "date", "invoice_date", "invoices")
_format_query("v5_valid_amount_format", "amount", "total_amount", "invoices")
_format_query("v6_valid_invoice_number", "invoice_number", "invoice_number", "invoices")
_format_query("v7_valid_tax_id", "tax_id", "tax_id", "vendor_contacts")


@query
def v8_check_items_total(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), listed(rules.check_items_total()))


@query
def v9_check_tax_sum(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), listed(rules.check_tax_sum()))


@query
def v10_check_date_order(spark, sf_dir):
    after = f"coalesce(({rules.check_date_order()}).code = 'invoice_after_due', false)"
    return _invoices(spark, sf_dir).selectExpr("doc_id", f"{rules.date_order_failed()} AS failed", f"{after} AS after_due")


@query
def v11_check_future_dates(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), rules.check_future_dates(DAY))


@query
def v12_check_text_presence(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), rules.check_text_presence())


@query
def v13_check_dependencies(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), rules.check_dependencies())


def _validated(spark, sf_dir, validation_type="comprehensive"):
    return rules.validate(docs.invoice_documents(spark, sf_dir), AS_OF, validation_type)


def _category_score(spark, sf_dir, category):
    one = _validated(spark, sf_dir, category).selectExpr("doc_id", "validation.categories[0] AS c")
    return one.selectExpr("doc_id", "c.status", "size(c.issues) AS issues", *_rounded("c.confidence"))


@query
def v14_score_consistency(spark, sf_dir):
    return _category_score(spark, sf_dir, "consistency")


@query
def v15_score_format(spark, sf_dir):
    return _category_score(spark, sf_dir, "format")


@query
def v16_check_amount_ranges(spark, sf_dir):
    # The limit is lowered so that the rule has something to find in these amounts.
    return _issues(_invoices(spark, sf_dir), rules.check_amount_ranges(maximum=250000))


@query
def v17_check_date_ranges(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), rules.check_date_ranges(DAY))


@query
def v18_check_vendor(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), listed(rules.check_vendor()))


@query
def v19_check_tax_rate(spark, sf_dir):
    return _issues(_invoices(spark, sf_dir), listed(rules.check_tax_rate()))


@query
def v20_score_business_rules(spark, sf_dir):
    one = _validated(spark, sf_dir, "business_rules").selectExpr("doc_id", "validation.categories[0] AS c", "validation.applied_rules")
    return one.selectExpr(
        "doc_id", "c.status", "size(c.issues) AS issues", *_rounded("c.confidence"), _joined("applied_rules", "applied_rules")
    )


@query
def v21_required_fields(spark, sf_dir):
    typed = view(spark, sf_dir, "typed_docs").selectExpr("doc_id", "text", "lower(text) AS lowered", "array('x') AS names")
    kind = texts.detect_validation_type("names", "text", "lowered")
    named = typed.selectExpr("doc_id", f"{kind} AS kind")
    return named.selectExpr("doc_id", "kind", _joined(rules.required_fields("kind"), "required"))


@query
def v22_check_completeness(spark, sf_dir):
    return _validated(spark, sf_dir, "completeness").selectExpr(
        "doc_id", _joined("validation.missing_fields", "missing"), _joined("validation.low_quality_fields", "low_quality"),
        "validation.categories[0].status AS status", *_rounded("validation.completeness_percentage"),
        "round(validation.categories[0].confidence, 6) AS confidence",
    )


@query
def v23_check_ocr_presence(spark, sf_dir):
    invoices = docs.invoice_documents(spark, sf_dir)
    recognised = layout.assemble_text(docs.invoice_tokens(invoices), threshold=0.0).select("doc_id", "extracted_content")
    compared = rules.text_against_ocr(invoices.join(recognised, "doc_id", "left"), "extracted_content")
    return compared.selectExpr(
        "doc_id", "ocr_consistency.status", "size(ocr_consistency.issues) AS issues",
        *_rounded("ocr_consistency.confidence"), "ocr_text_length", "extracted_fields",
    )


@query
def v24_overall_score(spark, sf_dir):
    return _validated(spark, sf_dir).selectExpr(
        "doc_id", *_rounded("validation.overall_score"), "validation.is_valid",
        _joined("validation.validated_fields", "validated_fields"),
    )


@query
def v25_recommendations(spark, sf_dir):
    return _validated(spark, sf_dir).selectExpr("doc_id", _joined("validation.recommendations", "recommendations"))


# --- results -----------------------------------------------------------------


@query
def r1_compile_results(spark, sf_dir):
    tasks, tokens = docs.recognised_documents(spark, sf_dir)
    compiled = process_documents(tasks, AS_OF, tokens=tokens)
    return compiled.selectExpr(
        "doc_id", "extraction_results.items_extracted", "extraction_results.pages_processed",
        "extraction_results.extraction_type", "extraction_results.extracted_text",
        *_rounded("extraction_results.extraction_confidence", "extraction_results.processing_time"),
        "analysis_results.document_type", "analysis_results.category", "analysis_results.analysis_confidence",
        "validation_results.is_valid", "round(validation_results.validation_score, 6) AS validation_score",
        "size(validation_results.issues) AS issues", _joined("validation_results.missing_fields", "missing_fields"),
        "coalesce(text_statistics.total_words, 0) AS total_words",
        "round(quality_metrics.overall_quality_score, 6) AS quality_score", "quality_metrics.quality_level",
        "round(overall_confidence, 6) AS overall_confidence",
    )


def _scored(spark, sf_dir):
    """Validated invoices with a recognition and an analysis confidence worked out from their number."""
    return _validated(spark, sf_dir).selectExpr(
        "doc_id", "validation.overall_score AS validation", "validation.is_valid AS is_valid",
        "cast(70 + doc_id % 31 AS double) / 100D AS ocr", "cast(50 + doc_id % 50 AS double) / 100D AS analysis",
    )



@query
def r2_quality_metrics(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    metrics_of = results.quality_metrics(F.col("ocr"), F.col("analysis"), F.col("validation"), F.col("is_valid"))
    return scored.select("doc_id", metrics_of.alias("q")).selectExpr(
        "doc_id", *_rounded("q.overall_quality_score", "q.reliability_score"), "q.quality_level"
    )


@query
def r3_quality_recommendations(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("is_valid", F.expr("doc_id % 4 <> 0"))
    score = results.quality_score(F.col("ocr"), F.col("analysis"), F.col("validation"))
    advice = results.quality_recommendations(score, F.col("is_valid"))
    return scored.select("doc_id", F.array_join(advice, "|").alias("recommendations"))


@query
def r4_overall_confidence(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("ocr", F.expr("IF(doc_id % 3 = 0, NULL, ocr)"))
    scored = scored.withColumn("analysis", F.expr("IF(doc_id % 5 = 0, NULL, analysis)"))
    total = results.overall_confidence(F.col("ocr"), F.col("analysis"), F.col("validation"))
    return scored.select("doc_id", F.round(total, 6).alias("overall_confidence"))


@query
def r5_envelope(spark, sf_dir):
    log = view(spark, sf_dir, "task_log")
    end = F.timestamp_micros(F.unix_micros("start_ts") + F.round(F.col("duration") * 1000000).cast("long"))
    sure = F.when(F.col("task_id") % 3 == 0, 0.9)
    wrapped = results.envelope(
        F.struct("document_type"), F.col("error"), "worker", F.col("task_id"), F.col("start_ts"), end, sure
    )
    return log.select(wrapped.alias("e")).selectExpr(
        "e.task_id", "e.success", "e.status", "coalesce(e.error.message, '') AS message",
        "coalesce(e.result.document_type, '') AS document_type", "round(e.timestamp.duration, 6) AS duration",
        "e.metrics.confidence AS confidence",
    )


@query
def r6_run_metadata(spark, sf_dir):
    clocked = docs.answered_documents(spark, sf_dir).selectExpr(
        "*", "timestamp_seconds(946684800 + doc_id) AS started_at",
        "IF(doc_id % 9 = 0, NULL, timestamp_millis((946684800 + doc_id) * 1000 + doc_id % 50 * 100)) AS finished_at",
    )
    compiled = process_documents(clocked, AS_OF, carry=["started_at", "finished_at"])
    return results.run_metadata(compiled, F.col("started_at"), F.col("finished_at")).selectExpr(
        "doc_id", "metadata.extraction_type", "metadata.output_format", "metadata.workflow_type",
        _joined("metadata.agents_involved", "agents_involved"), *_rounded("metadata.processing_time"),
        "date_format(metadata.timestamp, 'yyyy-MM-dd HH:mm:ss') AS timestamp",
        "round(metadata.overall_confidence, 6) AS overall_confidence",
    )


def _page_results(spark, sf_dir):
    """Pages of the prose documents with recognised text, entities and, for some, a failure."""
    pages = (
        view(spark, sf_dir, "ocr_tokens")
        .groupBy("doc_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"), F.avg("confidence").alias("confidence"))
        .selectExpr("doc_id", "page", "array_join(transform(t, x -> x.text), ' ') AS extracted_content", "confidence")
    )
    return pages.selectExpr(
        "doc_id", "page", "(doc_id + page) % 7 <> 0 AS success", "(doc_id + page) % 5 <> 0 AS analysis_success",
        "extracted_content", "confidence",
        f"{entities.extract_entities('extracted_content')} AS entities",
    )


def _folded(folded: DataFrame) -> DataFrame:
    return folded.selectExpr(
        "doc_id", "extracted_content", _joined("combined_entities", "combined_entities"),
        *_rounded("average_confidence"), "pages_processed",
    )


@query
def r7_combine_pages(spark, sf_dir):
    return _folded(results.combine_pages(_page_results(spark, sf_dir)))


@query
def r8_process_batch(spark, sf_dir):
    tasks, tokens = docs.recognised_documents(spark, sf_dir)
    tasks = tasks.selectExpr(
        "*", "IF(doc_id % 23 = 0, '', concat('/in/', doc_id)) AS document_path",
        "IF(doc_id % 29 = 0, 60, 1) * 1048576 AS size_bytes", "IF(doc_id % 31 = 0, '.exe', '.pdf') AS extension",
    )
    return process_batch(tasks, AS_OF, tokens=tokens, order=["doc_id"]).selectExpr(
        "doc_id", "position", "document_path", "success", "status", "coalesce(error.message, '') AS message",
        "coalesce(result.extraction_results.extraction_type, '') AS extraction_type",
        "length(result.extraction_results.extracted_text) AS extracted_chars",
        "coalesce(result.analysis_results.document_type, '') AS document_type",
        "coalesce(round(result.validation_results.validation_score, 6), -1D) AS validation_score",
        "round(metrics.confidence, 6) AS confidence",
    )


# --- sinks -------------------------------------------------------------------


def _compiled(spark, sf_dir):
    named = docs.answered_documents(spark, sf_dir).selectExpr("*", "concat('doc_', doc_id, '.pdf') AS filename")
    return process_documents(named, AS_OF)


@query
def k1_write_json(spark, sf_dir):
    path = streams.work_folder(spark, "json")
    writers.write_json_run(_compiled(spark, sf_dir), path, "first")
    schema = "doc_id long, quality_metrics struct<quality_level:string>, analysis_results struct<category:string,detailed_analysis:struct<confidence:double,meta:string>>"
    return versions.read_versions(spark, path, schema, "json").selectExpr(
        "doc_id", "quality_metrics.quality_level", "analysis_results.category",
        "analysis_results.detailed_analysis.confidence AS confidence", "analysis_results.detailed_analysis.meta AS meta",
    )


@query
def k1_pretty_json(spark, sf_dir):
    """Results as indented text, a document each."""
    scored = _scored(spark, sf_dir).selectExpr("doc_id", "is_valid", "concat('é ', doc_id % 7) AS note", "array(doc_id % 3, 1L) AS counts")
    return writers.pretty_json(scored)


def _report_parts():
    return [
        F.substring("text", 1, 40), F.concat(F.lit("f<"), F.col("doc_id").cast("string"), F.lit(">.pdf")), F.lit("a&b"),
        F.expr("cast(70 + doc_id % 31 AS double) / 100D"), F.col("text"),
    ]


@query
def k2_render_markdown(spark, sf_dir):
    return view(spark, sf_dir, "typed_docs").select("doc_id", writers.render_markdown(*_report_parts()).alias("report"))


@query
def k3_write_entities_csv(spark, sf_dir):
    found = view(spark, sf_dir, "invoice_texts").selectExpr("doc_id", f"{entities.extract_entities('text')} AS entities")
    path = streams.work_folder(spark, "csv")
    writers.write_entities_csv(found, path)
    return spark.read.schema("doc_id long, Type string, Entity string").option("header", True).csv(path)


@query
def k4_render_html(spark, sf_dir):
    return view(spark, sf_dir, "typed_docs").select("doc_id", writers.render_html(*_report_parts()).alias("report"))


@query
def k5_write_events(spark, sf_dir):
    log = view(spark, sf_dir, "task_log")
    path = streams.work_folder(spark, "events")
    activity = log.selectExpr("*", "status AS activity", "document_type AS details")
    calls = log.selectExpr("*", "'/process' AS endpoint", "'POST' AS method", "IF(error IS NULL, 200, 500) AS status_code")
    for events in (writers.agent_activity_events(activity), writers.processing_events(log), writers.api_call_events(calls)):
        writers.write_events(events, path, "first")
    return versions.read_versions(spark, path, writers.EVENTS).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.expr("get_json_object(payload, '$.success') = 'false'")).alias("failures"),
        F.count_if(F.expr("get_json_object(payload, '$.document_type') = 'unknown'")).alias("unknown"),
        F.count_if(F.expr("get_json_object(payload, '$.status_code') = '500'")).alias("bad_calls"),
        F.round(F.sum(F.expr("cast(get_json_object(payload, '$.processing_time') AS double)")), 3).alias("seconds"),
    ).withColumn("event_type", F.col("event_type").cast("string"))


# --- log analytics -----------------------------------------------------------

_STAMP = "date_format({}, 'yyyy-MM-dd HH:mm:ss')"


@query
def m1_agent_status(spark, sf_dir):
    return metrics.agent_status(view(spark, sf_dir, "task_log")).selectExpr(
        "agent", "total_tasks", "error_count", *_rounded("success_rate"), "status",
        f"{_STAMP.format('last_activity')} AS last_activity",
    )


@query
def m2_last_n(spark, sf_dir):
    return metrics.last_n(view(spark, sf_dir, "task_log"), 1000).select("agent", "task_id", "recency")


@query
def m3_performance_metrics(spark, sf_dir):
    return metrics.performance_metrics(view(spark, sf_dir, "task_log")).selectExpr(
        "agent", "period", "total_tasks", "successful_tasks", "failed_tasks",
        *_rounded("success_rate", "average_processing_time"),
        _joined("transform(recent_errors, e -> concat(e.task_id, ':', e.error))", "recent_errors"),
    )


@query
def m4_health(spark, sf_dir):
    return metrics.health(metrics.agent_status(view(spark, sf_dir, "task_log"))).selectExpr(
        "agent", "status", "healthy", *_rounded("success_rate")
    )


@query
def m5_system_health(spark, sf_dir):
    return metrics.system_health(metrics.agent_status(view(spark, sf_dir, "task_log")))


@query
def m6_overall_statistics(spark, sf_dir):
    return metrics.overall_statistics(metrics.agent_status(view(spark, sf_dir, "task_log"))).selectExpr(
        "total_tasks_processed", "total_errors", *_rounded("overall_success_rate"), "active_agents"
    )


@query
def m7_recent_history(spark, sf_dir):
    return metrics.recent_history(view(spark, sf_dir, "task_log")).select("task_id", "document_type", "duration")


def _runs(spark, sf_dir):
    return view(spark, sf_dir, "task_log").selectExpr(
        "task_id % 200 AS doc_id", "status = 'completed' AS success", "duration AS processing_time", "document_type",
        "cast(50 + task_id % 50 AS double) / 100D AS confidence",
        "element_at(array('text', 'table', 'structure', 'full'), cast(1 + task_id % 4 AS int)) AS extraction_type",
    )


@query
def m8_run_report(spark, sf_dir):
    report = metrics.run_report(_runs(spark, sf_dir))
    figures = [f"{a}_{b}" for b in ("processing_time", "confidence") for a in ("avg", "min", "max")]
    return report.selectExpr("total_tests", "successful", "failed", *_rounded("success_rate", *figures))


@query
def m8_documents_per_type(spark, sf_dir):
    return metrics.documents_per_type(_runs(spark, sf_dir))


@query
def m9_timing_by_document(spark, sf_dir):
    timing = metrics.timing_by_document(_runs(spark, sf_dir))
    return timing.selectExpr("doc_id", *_rounded(*[f"{a}_processing_time" for a in ("avg", "min", "max")]))


@query
def m10_extraction_matrix(spark, sf_dir):
    matrix = metrics.extraction_matrix(_runs(spark, sf_dir))
    return matrix.selectExpr("doc_id", *[f"coalesce(int({t}), -1) AS {t}_ok" for t in ("text", "table", "structure", "full")])


def _found_entities(spark, sf_dir):
    return view(spark, sf_dir, "invoice_texts").selectExpr("doc_id", f"{entities.extract_entities('text')} AS entities")


@query
def m11_entity_counts(spark, sf_dir):
    return metrics.entity_counts(_found_entities(spark, sf_dir))


@query
def m11_entity_totals(spark, sf_dir):
    return metrics.entity_totals(_found_entities(spark, sf_dir))


@query
def m12_issue_counts(spark, sf_dir):
    return metrics.issue_counts(_validated(spark, sf_dir))


# --- streams -----------------------------------------------------------------

_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _arriving_pages(spark, sf_dir):
    """Paragraphs of the documents as a stream of pages, with the number of pages their document has."""
    arriving = streams.stream_table(spark, f"{sf_dir}/documents.parquet", _DOCUMENTS)
    return arriving.selectExpr("doc_id", "size(split(text, '\\n\\n')) AS pages_total", "posexplode(split(text, '\\n\\n')) AS (at, text)").selectExpr(
        "doc_id", "at + 1 AS page", "pages_total", "text",
        # pages that get no response come first, so that their time has run out at the end
        "timestamp_seconds(IF((doc_id + at) % 11 = 0, 946684800, 949276800)) AS ts",
    )


@query
def t1_stream_pages(spark, sf_dir):
    pages = _arriving_pages(spark, sf_dir)
    reply = "concat('{\"summary\":\"page ', page, '\",\"confidence\":0.9,\"total_amount\":\"$', doc_id % 1000, '.00\"}')"
    responses = _arriving_pages(spark, sf_dir).where("(doc_id + page - 1) % 11 <> 0").selectExpr("doc_id", "page", "ts", f"{reply} AS response")
    folder = streams.work_folder(spark, "pages")
    done = streams.process_pages(streams.join_responses(pages, responses), AS_OF)
    streams.run_to_table(done, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").selectExpr(
        "doc_id", "page", "success", "analysis_success", "validation_success", "coalesce(error, '') AS error", "document_type", "category",
        "text_stats.total_words AS total_words", "size(entities['amounts']) AS amounts",
        *_rounded("validation.overall_score"), "validation.is_valid",
    )


@query
def t2_stream_combine(spark, sf_dir):
    pages = _arriving_pages(spark, sf_dir).selectExpr(
        "doc_id", "page", "pages_total", "ts", "(doc_id + page - 1) % 7 <> 0 AS success", "text AS extracted_content",
        "cast(50 + (doc_id + page - 1) % 50 AS double) / 100D AS confidence",
        f"{entities.extract_entities('text')} AS entities",
    )
    folder = streams.work_folder(spark, "documents")
    streams.run_to_table(streams.stream_documents(pages), f"{folder}/out", f"{folder}/checkpoint")
    whole = spark.read.parquet(f"{folder}/out")
    return _folded(results.combine_pages(whole.where("complete")))


# --- user code ---------------------------------------------------------------


@query
def u1_apply_per_document(spark, sf_dir):
    def shout(row):
        if row["doc_id"] % 10 == 3:
            raise ValueError("unreadable")
        return {"chars": len(row["text"]), "head": row["text"][:10].upper()}

    done = userfn.apply_per_document(base(spark, sf_dir, "documents").select("doc_id", "text"), shout, "chars int, head string")
    return done.selectExpr(
        "doc_id", "success", "status", "coalesce(error.message, '') AS message", "coalesce(result.chars, -1) AS chars"
    )


@query
def u2_apply_in_batches(spark, sf_dir):
    def recognise(rows):
        if any(r["doc_id"] % 10 == 3 for r in rows):
            raise ValueError("unreadable")
        return [[{"text": w, "confidence": 0.5} for w in r["text"].split()] for r in rows]

    paged = base(spark, sf_dir, "documents").selectExpr("doc_id", "1 AS page", "text")
    done = userfn.apply_in_batches(paged, recognise, "text string, confidence double")
    return done.selectExpr("doc_id", "page", "size(items) AS items")
