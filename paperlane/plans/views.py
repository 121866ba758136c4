"""Views derived from the warehouse tables: invoices, their texts, model responses, tokens, logs.

The statements are plain SQL that other engines run as well; `{x}` stands for a
base table. `text_lines` is the one statement with an engine's own syntax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["lineitem", "part", "orders", "customer", "documents", "events"]

VIEW_SQL = {
    "invoice_items": """
        SELECT l_orderkey AS doc_id, l_linenumber AS line_no, p_name AS description,
          CAST(l_quantity AS INT) AS quantity,
          CAST(l_extendedprice AS DECIMAL(15,2)) AS total_price
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "invoices": """
        WITH s AS (SELECT l_orderkey AS doc_id, COUNT(*) AS n,
                     CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS item_sum
                   FROM {lineitem} GROUP BY l_orderkey),
        b AS (SELECT o_orderkey AS doc_id, c_name, COALESCE(n, 0) AS n_items,
                COALESCE(item_sum, CAST(0 AS DECIMAL(18,2))) AS item_sum,
                CAST(o_totalprice AS DECIMAL(18,2)) AS stated,
                CAST(CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate - INTERVAL '20' YEAR ELSE o_orderdate END AS DATE) AS d
              FROM {orders} JOIN {customer} ON c_custkey = o_custkey LEFT JOIN s ON s.doc_id = o_orderkey),
        t AS (SELECT *, CAST(ROUND(CASE WHEN doc_id % 19 = 0 THEN item_sum * 0.40 ELSE item_sum * 0.08 END, 2)
                AS DECIMAL(18,2)) AS tax,
                CAST(YEAR(d) AS STRING) AS yy, CAST(MONTH(d) AS STRING) AS mm, CAST(DAY(d) AS STRING) AS dd FROM b)
        SELECT doc_id,
          CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 59 = 0 THEN 'X' ELSE c_name END AS vendor_name,
          CASE WHEN doc_id % 41 = 0 THEN 'N-' || CAST(doc_id AS STRING)
               ELSE 'INV' || LPAD(CAST(doc_id AS STRING), 8, '0') END AS invoice_number,
          CASE WHEN doc_id % 43 = 0 THEN 'soon'
               WHEN doc_id % 4 = 0 THEN yy || '-' || LPAD(mm, 2, '0') || '-' || LPAD(dd, 2, '0')
               WHEN doc_id % 4 = 1 THEN dd || '/' || mm || '/' || yy
               WHEN doc_id % 4 = 2 THEN mm || '/' || dd || '/' || RIGHT(yy, 2)
               ELSE LPAD(mm, 2, '0') || '/' || LPAD(dd, 2, '0') || '/' || yy END AS invoice_date,
          CASE WHEN doc_id % 7 = 0 THEN '01/01/1990' WHEN doc_id % 3 = 0 THEN '12/31/2001' ELSE '01/20/2000' END AS due_date,
          CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '$' || CAST(item_sum - tax AS STRING) END AS subtotal,
          '$' || CAST(tax AS STRING) AS tax_amount,
          '$' || CAST(CASE WHEN doc_id % 2 = 0 THEN item_sum ELSE stated END AS STRING) AS total_amount,
          n_items, item_sum
        FROM t""",
    "invoice_texts": """
        SELECT doc_id, 'INVOICE #' || invoice_number || chr(10) || 'Date: ' || invoice_date || chr(10)
          || 'Vendor: ' || COALESCE(vendor_name, '') || chr(10)
          || CASE WHEN doc_id % 11 = 0 THEN '- important: settle this invoice by ' || due_date || chr(10) ELSE '' END
          || 'Contact: billing' || CAST(doc_id AS STRING) || '@example.com' || chr(10)
          || 'Tax: ' || tax_amount || chr(10) || 'Total: ' || total_amount AS text
        FROM invoices""",
    "llm_responses": """
        WITH j AS (SELECT doc_id, '{{"vendor_name":"' || COALESCE(vendor_name, '') || '","invoice_date":"' || invoice_date
            || '","total_amount":"' || total_amount || '","_trace":"x","meta":{{"_id":1,"tags":[{{"_x":[{{}}],"y":1.25}}]}},"confidence":0.9}}' AS js, total_amount FROM invoices)
        SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN js
          WHEN 1 THEN 'Here is the result: ' || js || ' Done.'
          WHEN 2 THEN js || ' and {{"b":2}}'
          WHEN 3 THEN '[1,2]'
          WHEN 4 THEN 'Dated 01/15/2024, part $ 10.00, total ' || total_amount || ', valid'
          ELSE '' END AS response FROM j""",
    "typed_docs": """
        SELECT doc_id, CASE doc_id % 10
          WHEN 0 THEN 'Invoice number 7, payment due date, total amount. '
          WHEN 1 THEN 'This AGREEMENT between each party, effective date, termination. '
          WHEN 2 THEN 'Registration form, signature, date of birth. '
          WHEN 3 THEN 'Report: findings, conclusion and recommendations. '
          WHEN 4 THEN 'Dear reader, kind regards. '
          WHEN 5 THEN 'Court: plaintiff, defendant, attorney. '
          WHEN 6 THEN 'Balance sheet, income, expenses, profit. '
          WHEN 7 THEN 'Patient diagnosis and treatment. '
          WHEN 8 THEN 'System architecture manual, requirements. '
          ELSE '' END || CASE WHEN doc_id % 3 = 0
            THEN chr(10) || '- an important point that is long enough' || chr(10) ELSE '' END || text AS text
        FROM {documents}""",
    "task_log": """
        SELECT event_id AS task_id, CAST(user_id % 5 AS INT) AS agent, CAST(ts AS TIMESTAMP) AS start_ts, value AS duration,
          CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status,
          CASE WHEN event_type = 'error' THEN props END AS error, event_type AS document_type
        FROM {events}""",
    "vendor_contacts": """
        SELECT c_custkey AS doc_id,
          CASE WHEN c_custkey % 9 = 0 THEN 'bad@' ELSE 'c' || CAST(c_custkey AS STRING) || '@example.com' END AS contact_email,
          CASE c_custkey % 3 WHEN 0 THEN '+1 (555) 010-' || LPAD(CAST(c_custkey AS STRING), 4, '0')
            WHEN 1 THEN '555-01' ELSE LPAD(CAST(c_custkey AS STRING), 10, '5') END AS contact_phone,
          CASE c_custkey % 4 WHEN 0 THEN '12-' || LPAD(CAST(c_custkey AS STRING), 7, '0')
            WHEN 1 THEN LPAD(CAST(c_custkey AS STRING), 9, '0') ELSE 'T' || CAST(c_custkey AS STRING) END AS tax_id
        FROM {customer}""",
    "text_lines": r"SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM {documents}",
    "ocr_tokens": """
        SELECT doc_id, CAST(pos AS INT) AS pos, CAST(FLOOR(pos / 40) AS INT) + 1 AS page, line AS text,
          CAST(50 + (doc_id * 31 + pos * 17) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
          CAST((pos % 40) * 25 + CASE WHEN (doc_id + pos) % 4 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS y_min,
          CAST((doc_id * 7 + pos * 13) % 600 AS DOUBLE) AS x_min
        FROM text_lines""",
}

NEEDS = {
    "invoice_items": [],
    "invoices": [],
    "invoice_texts": ["invoices"],
    "llm_responses": ["invoices"],
    "typed_docs": [],
    "task_log": [],
    "vendor_contacts": [],
    "text_lines": [],
    "ocr_tokens": ["text_lines"],
}


def view_chain(names: list[str], statements: dict[str, str] = VIEW_SQL) -> list[tuple[str, str]]:
    """The named views and what they read, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS[name]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return [(name, statements[name]) for name in ordered]


def spread_over(spark: SparkSession) -> int:
    """Number of partitions that rows are dealt to before costly expressions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the parquet files of `sf_dir`.

    Responses are small rows with costly parsing on top. Left as the join of invoices gives them, they stay in as many tasks as the file
    of orders has pieces; so the invoices below them are dealt to a number of partitions that adaptive execution keeps.
    """
    sources = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE_TABLES}
    chain = [(n, sql.format(**sources)) for n, sql in view_chain([name])]
    if name == "llm_responses":
        dealt = f"SELECT /*+ REPARTITION({spread_over(spark)}, doc_id) */ * FROM joined_invoices"
        chain = [part for n, sql in chain for part in ([("joined_invoices", sql), (n, dealt)] if n == "invoices" else [(n, sql)])]
    return spark.sql("WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in chain) + f" SELECT * FROM {name}")
