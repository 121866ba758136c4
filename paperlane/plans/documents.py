"""Documents ready for the operators, built from the derived views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import jsontext
from ..functions.sql import listed, struct
from .views import spread_over, view

AS_OF = dt.date(2000, 1, 1)

INVOICE_FIELDS = [
    "vendor_name", "invoice_number", "invoice_date", "due_date", "subtotal", "tax_amount", "total_amount",
]


def fields_from_columns(columns: list[str], lists: dict[str, str] | None = None) -> str:
    """Field map of flat string columns; NULL columns are absent keys.

    `lists` names array-valued fields with the condition under which they are
    present; their content is summed up elsewhere.
    """
    pairs = [f"IF({c} IS NOT NULL, {struct(key=f"'{c}'", value=jsontext.entry("'string'", c))}, NULL)" for c in columns]
    for name, present in (lists or {}).items():
        pairs.append(f"IF({present}, {struct(key=f"'{name}'", value=jsontext.entry("'array'", "'[...]'"))}, NULL)")
    return f"map_from_entries({listed(*pairs)})"


# The text of an invoice rendered in its own row, which spares joining the texts to the fields.
INVOICE_TEXT = """
    'INVOICE #' || invoice_number || '\\n' || 'Date: ' || invoice_date || '\\n'
    || 'Vendor: ' || COALESCE(vendor_name, '') || '\\n'
    || IF(doc_id % 11 = 0, '- important: settle this invoice by ' || due_date || '\\n', '')
    || 'Contact: billing' || STRING(doc_id) || '@example.com' || '\\n'
    || 'Tax: ' || tax_amount || '\\n' || 'Total: ' || total_amount"""


def invoice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as extracted field maps, with the text they were taken from; dealt to all tasks, as their checks are costly."""
    return view(spark, sf_dir, "invoices").repartition(spread_over(spark), "doc_id").selectExpr(
        "doc_id",
        f"{INVOICE_TEXT} AS text",
        f"{fields_from_columns(INVOICE_FIELDS, {'items': 'n_items > 0'})} AS fields",
        "IF(n_items > 0, cast(item_sum AS decimal(38,8)), NULL) AS items_total",
    )


def contact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor contacts as field maps."""
    fields = fields_from_columns(["contact_email", "contact_phone", "tax_id"])
    return view(spark, sf_dir, "vendor_contacts").selectExpr("doc_id", f"{fields} AS fields")


# A model's response to the invoice, likewise rendered in place.
INVOICE_RESPONSE = """
    CASE doc_id % 6 WHEN 0 THEN _js
      WHEN 1 THEN 'Here is the result: ' || _js || ' Done.'
      WHEN 2 THEN _js || ' and {"b":2}'
      WHEN 3 THEN '[1,2]'
      WHEN 4 THEN 'Dated 01/15/2024, part $ 10.00, total ' || total_amount || ', valid'
      ELSE '' END"""
_JSON = (
    "'{\"vendor_name\":\"' || coalesce(vendor_name, '') || '\",\"invoice_date\":\"' || invoice_date "
    "|| '\",\"total_amount\":\"' || total_amount || '\",\"_trace\":\"x\",\"meta\":{\"_id\":1,\"tags\":[{\"_x\":[{}],\"y\":1.25}]},\"confidence\":0.9}'"
)


def answered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice texts with the response of a model, type to be detected."""
    return view(spark, sf_dir, "invoices").selectExpr(
        "doc_id", f"{INVOICE_TEXT} AS text", f"{_JSON} AS _js", "total_amount"
    ).selectExpr("doc_id", "text", f"{INVOICE_RESPONSE} AS response", "'auto' AS requested_type")


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the prose documents, with the time their page took."""
    return view(spark, sf_dir, "ocr_tokens").withColumn(
        "processing_time", F.expr("cast(page % 7 + doc_id % 3 AS double) / 10D")
    )


def invoice_tokens(documents: DataFrame) -> DataFrame:
    """Lines of invoice texts as tokens, four to a page; every 13th document was not recognised."""
    return (
        documents.where("doc_id % 13 <> 0")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .selectExpr(
            "doc_id", "pos", "cast(floor(pos / 4) AS int) + 1 AS page", "text",
            "cast(50 + (doc_id * 31 + pos * 17) % 50 AS double) / 100D AS confidence",
            "cast((pos % 4) * 25 + IF((doc_id + pos) % 4 = 0, 40, 0) AS double) AS y_min",
            "cast((doc_id * 7 + pos * 13) % 600 AS double) AS x_min",
            "0.25D AS processing_time",
        )
    )


EXTRACTION_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'structure' WHEN 3 THEN 'full' ELSE 'other' END"


def recognised_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Invoices to be extracted from tokens, each by its own type, with the response of a model; and the tokens."""
    answered = answered_documents(spark, sf_dir)
    tasks = answered.selectExpr("doc_id", "response", "'invoice' AS requested_type", f"{EXTRACTION_TYPE} AS extraction_type")
    return tasks, invoice_tokens(answered)
