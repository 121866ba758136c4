"""Files in and out, streams, user code, logs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from paperlane.operators import admission, layout, metrics, results, userfn
from paperlane.plans import batch, documents, registry
from paperlane.sources import readers, versions, writers
from paperlane.streaming import pages as streams


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())


def test_catalog(spark, folder):
    put(folder, "a.PDF", b"x" * 1572864)
    put(folder, "b.exe", b"y")
    put(folder, "noext", b"z")
    rows = {r.filename: r for r in readers.document_catalog(spark, folder).collect()}
    assert (rows["a.PDF"].extension, rows["a.PDF"].size_mb, rows["a.PDF"].supported) == (".pdf", 1.5, True)
    assert not rows["b.exe"].supported and rows["noext"].extension == ""
    small = readers.document_catalog(spark, folder, max_bytes=10)
    assert small.count() == 2
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "PushedFilters" in plan and "LessThanOrEqual(length" in plan


def test_text_files(spark, folder):
    put(folder, "a.txt", "one\n\n two\n".encode() + b"\xff")
    put(folder, "b.MD", "# h")
    put(folder, "c.bin", "no")
    rows = {r.filename: r for r in readers.read_text_documents(spark, folder).collect()}
    assert set(rows) == {"a.txt", "b.MD"} and rows["a.txt"].extracted_content == "one\n\n two\n"
    items = readers.text_items(readers.read_text_documents(spark, folder), "filename", "extracted_content")
    assert [r.text for r in items.where("filename = 'a.txt'").orderBy("line_no").collect()] == ["one", " two"]


def test_raw_ocr(spark, folder):
    line = {"poly": [[5, 1], [9, 2], [9, 4], [5, 3]], "text": "t", "confidence": 0.9}
    put(folder, "p.json", json.dumps({"doc_id": 1, "page": 2, "processing_time": 0.1, "lines": [line]}))
    row = readers.read_ocr(spark, folder).first()
    assert (row.pos, row.x_min, row.y_min, row.x_max, row.y_max, row.page) == (0, 5, 1, 9, 4, 2)


def test_chat_responses(spark, folder):
    ok = {"doc_id": 1, "status": 200, "choices": [{"message": {"role": "assistant", "content": " hi\n"}}]}
    put(folder, "r.json", "\n".join(json.dumps(r) for r in [ok, {"doc_id": 2, "choices": []}, {**ok, "doc_id": 3, "status": 429}]))
    rows = {r.doc_id: (r.response, r.error) for r in readers.read_chat_responses(spark, folder).collect()}
    assert rows == {1: ("hi", None), 2: (None, "No choices in response"), 3: (None, "HTTP 429")}


def test_admission_conserves_rows(spark):
    mb = 1024 * 1024
    files = spark.createDataFrame([(50 * mb, ".pdf"), (50 * mb + 1, ".exe"), (1, ".exe"), (1, ".JPG"), (1, "")], "size_bytes long, extension string")
    accepted, rejected = admission.admit(files)
    assert accepted.count() + rejected.count() == 5
    assert [r.reason.split()[0] for r in rejected.orderBy(F.desc("size_bytes")).collect()] == ["File", "Unsupported", "Unsupported"]


def test_required_input(spark):
    tasks = spark.createDataFrame([("t", "p"), (None, "p"), ("t", "")], "type string, document_path string")
    found = [r.error.message if r.error else None for r in admission.require_input(tasks).collect()]
    assert found[0] is None and found[1].startswith("Invalid task") and found[2].startswith("Either document_path")


def test_batch_rows_and_sinks(spark, folder):
    rows = [
        (1, "Invoice $5.00", '{"vendor_name":"Acme","note":"é","_p":1,"total_amount":"$12,345,678.50"}', "auto", "/in/1", 10, ".pdf"),
        (2, "", "x", "auto", "/in/2", 10, ".pdf"),
        (3, "text", "x", "auto", "/in/3", 10, ".exe"),
        (4, "text", None, "auto", "", 10, ".pdf"),
    ]
    tasks = spark.createDataFrame(rows, "doc_id int, text string, response string, requested_type string, document_path string, size_bytes long, extension string")
    found = {r.doc_id: r for r in batch.process_batch(tasks, documents.AS_OF).collect()}
    assert len(found) == 4 and [found[i].success for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert found[3].error.message.startswith("Unsupported") and found[3].result is None and found[3].metrics.confidence == 0.0
    assert found[2].result.validation_results.validation_status == "unknown"
    assert found[2].result.validation_results.validation_score == 0.0

    compiled = batch.process_documents(tasks, documents.AS_OF)
    writers.write_json(compiled, folder + "/json")
    lines = [json.loads(line) for line in spark.read.text(folder + "/json").toPandas().value]
    details = next(r for r in lines if r["doc_id"] == 1)["analysis_results"]["detailed_analysis"]
    assert details["note"] == "é" and "_p" not in details and details["total_amount_numeric"] == 12345678.5
    large = compiled.where("doc_id = 1").first().validation_results.issues
    assert [i.field for i in large if i.code == "amount_too_large"] == ["total_amount", "total_amount_numeric"]
    pretty = writers.pretty_json(compiled.select("doc_id", "overall_confidence")).where("doc_id = 1").first().json
    assert json.loads(pretty)["doc_id"] == 1 and "\n" in pretty
    reports = writers.report_columns(compiled).where("doc_id = 1").first()
    assert reports.markdown.startswith("# ") and "<pre>" in reports.html

    found_entities = compiled.select("doc_id", F.col("analysis_results.entities").alias("entities"))
    writers.write_entities_csv(found_entities, folder + "/csv")
    assert spark.read.option("header", True).csv(folder + "/csv").where("Type = 'amounts'").first().Entity == "$5.00"


def test_user_code_errors_become_rows(spark):
    frame = spark.range(20).withColumnRenamed("id", "doc_id").repartition(3)

    def check(row):
        if row["doc_id"] == 3:
            raise ValueError("three")
        return {"double": row["doc_id"] * 2} if row["doc_id"] != 4 else [1]

    rows = {r.doc_id: r for r in userfn.apply_per_document(frame, check, "double long").collect()}
    assert len(rows) == 20 and rows[5].result.double == 10 and rows[5].success
    assert rows[3].error.message == "three" and rows[4].status == "error" and rows[3].result is None


def test_user_code_gets_exact_integers_and_none(spark):
    frame = spark.sql("SELECT * FROM VALUES (1L, 9007199254740993L), (2L, NULL) AS t(doc_id, n)").coalesce(1)
    seen = {r.doc_id: r.result.seen for r in userfn.apply_per_document(frame, lambda row: {"seen": repr(row["n"])}, "seen string").collect()}
    assert seen == {1: "9007199254740993", 2: "None"}


def test_batches_isolate_failures(spark):
    frame = spark.range(11).selectExpr("id AS doc_id", "1 AS page").repartition(2)

    def recognise(rows):
        if any(r["doc_id"] == 7 for r in rows):
            raise ValueError("seven")
        assert len(rows) <= 5
        return [[{"text": str(r["doc_id"])}] for r in rows]

    rows = {r.doc_id: r["items"] for r in userfn.apply_in_batches(frame, recognise, "text string").collect()}
    assert len(rows) == 11 and rows[7] == [] and rows[6][0].text == "6"


PAGES = "doc_id long, page int, success boolean, extracted_content string, confidence double, entities map<string,array<string>>"


def page_rows():
    return [
        (1, 2, True, "b", 0.8, {"emails": ["x@y.zz"]}),
        (1, 1, True, "a", 0.6, {"emails": [], "dates": ["1/2/24"]}),
        (1, 3, False, None, None, None),
        (2, 1, False, None, None, None),
    ]


@pytest.mark.parametrize("per_part", [1, 1024])
def test_combine_pages(spark, monkeypatch, per_part):
    monkeypatch.setattr(results, "PAGES_PER_PART", per_part)
    rows = {r.doc_id: r for r in results.combine_pages(spark.createDataFrame(page_rows(), PAGES)).collect()}
    assert rows[1].extracted_content == "a b" and rows[1].combined_entities == ["1/2/24", "x@y.zz"]
    assert rows[1].average_confidence == pytest.approx(1.4 / 3) and rows[1].pages_processed == 3
    assert rows[2].extracted_content == "" and rows[2].average_confidence == 0.0


def test_sessions_of_one_part_keep_page_order(spark):
    pages = spark.createDataFrame(page_rows(), PAGES)
    parts = results.page_parts(pages.where("page % 2 = 0")).union(results.page_parts(pages.where("page % 2 = 1")))
    rows = {r.doc_id: r for r in results.fold_parts(parts).collect()}
    assert rows[1].extracted_content == "a b" and rows[1].pages_processed == 3 and rows[2].extracted_content == ""


def test_stream_with_watermark_closes_parts(spark, folder):
    source, out = folder + "/in", folder + "/out"
    pages = spark.createDataFrame(page_rows(), PAGES).withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("page")))
    late = pages.where("doc_id = 2").withColumn("ts", F.timestamp_seconds(F.lit(1800000000)))
    pages.write.parquet(source)
    late.write.mode("append").parquet(source)
    stream = streams.stream_pages(spark, source, f"{PAGES}, ts timestamp")
    parts = streams.stream_parts(stream, watermark="1 minute", gap="5 minutes")
    streams.run_to_table(parts, out, folder + "/checkpoint")
    closed = results.fold_parts(spark.read.parquet(out))
    assert {r.doc_id: r.extracted_content for r in closed.collect()}[1] == "a b"


def arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


TOKENS = "doc_id long, page int, pos int, text string, confidence double, y_min double, x_min double, page_tokens int, ts timestamp"


def token_rows():
    at = dt.datetime(2024, 1, 1)
    return [(i % 2, 1 + i // 20, i, f"w{i}", 1.0, float(i * 17 % 200), float(i * 13 % 90), 10, at + dt.timedelta(seconds=i)) for i in range(40)]


def test_a_page_spread_over_batches_is_laid_out_whole(spark, folder):
    rows, source, out = token_rows(), folder + "/in", folder + "/out"
    for some in (rows[:13], rows[13:29] + rows[:2], rows[29:]):  # a restart between them, two tokens twice
        arrive(spark, some, TOKENS, source)
        stream = streams.stream_pages(spark, source, TOKENS)
        streams.stream_layout(stream, out, folder + "/checkpoint").awaitTermination()
    batch_cells = layout.group_rows(spark.createDataFrame(rows, TOKENS))
    cells = versions.read_versions(spark, out, batch_cells.schema)
    key = ["doc_id", "page", "pos", "table_no", "row_no", "col_no"]
    found = sorted(map(tuple, cells.select(key).collect()))
    assert found == sorted(map(tuple, batch_cells.select(key).collect())) and found
    assert len(versions.committed(spark, out)) >= 3


def test_documents_leave_when_whole_or_out_of_time(spark, folder):
    schema = "doc_id long, page int, pages_total int, success boolean, extracted_content string, confidence double, entities map<string,array<string>>, ts timestamp"
    day = lambda n: dt.datetime(2024, 1, n)
    page = lambda doc, n, of, at: (doc, n, of, True, f"{doc}.{n}", 0.5, {"emails": [f"e{n}"]}, at)
    arrivals = [
        [page(1, 2, 3, day(1)), page(2, 1, 2, day(1)), page(3, 1, 1, day(1))],
        [page(1, 1, 3, day(1)), page(1, 2, 3, day(1)), page(3, 1, 1, day(1))],  # doc 3 was whole, its page comes again
        [page(1, 3, 3, day(1)), page(4, 1, 2, day(9)), page(5, 1, None, day(9))],  # time passes: doc 2 lacks a page
        [page(2, 2, 2, day(1)), page(6, 1, 1, day(20))],  # too late for doc 2
    ]
    left = []
    for rows in arrivals:
        arrive(spark, rows, schema, folder + "/in")
        stream = streams.stream_documents(streams.stream_pages(spark, folder + "/in", schema), timeout_minutes=60)
        streams.run_to_table(stream, folder + "/out", folder + "/checkpoint")
        left.append({(r.doc_id, r.page, r.complete) for r in spark.read.parquet(folder + "/out").collect()})
    assert left[0] == {(3, 1, True)} == left[1]
    assert left[2] >= {(3, 1, True), (1, 1, True), (1, 2, True), (1, 3, True)}
    assert left[3] == {(3, 1, True), *((1, p, True) for p in (1, 2, 3)), (2, 1, False), (4, 1, False), (5, 1, False), (6, 1, True)}
    table = spark.read.parquet(folder + "/out")
    assert table.count() == len(left[3]) and table.where("doc_id = 1 AND page = 2").first().ts == day(1)
    folded = {r.doc_id: r for r in results.combine_pages(table).collect()}
    assert folded[1].extracted_content == "1.1 1.2 1.3" and folded[1].combined_entities == ["e1", "e2", "e3"]


def test_pages_meet_their_responses(spark, folder):
    pages = "doc_id long, page int, text string, ts timestamp"
    replies = "doc_id long, page int, response string, ts timestamp"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    reply = '{"summary":"invoice total","total_amount":"$5.00","confidence":0.7}'
    batches = [
        ([(1, 1, "Invoice total $5.00", at(0)), (1, 2, "no reply ever", at(0)), (1, 3, "", at(0)), (2, 1, "late reply", at(0))], [(1, 3, reply, at(0))]),
        ([(9, 9, "clock", at(0.2))], [(1, 1, reply, at(0.5)), (9, 9, "prose", at(0.3))]),
        ([(8, 1, "clock", at(30))], [(8, 1, reply, at(30)), (2, 1, reply, at(29))]),
        ([(7, 1, "clock", at(60))], [(7, 1, reply, at(60))]),
    ]
    for some, answers in batches:
        arrive(spark, some, pages, folder + "/pages")
        arrive(spark, answers, replies, folder + "/replies")
        joined = streams.join_responses(streams.stream_pages(spark, folder + "/pages", pages), streams.stream_pages(spark, folder + "/replies", replies))
        streams.run_to_table(streams.process_pages(joined, documents.AS_OF), folder + "/out", folder + "/checkpoint")
    rows = {(r.doc_id, r.page): r for r in spark.read.parquet(folder + "/out").collect()}
    outcome = {k: (r.success, r.analysis_success, r.validation_success) for k, r in rows.items() if k[0] < 7}
    assert outcome == {(1, 1): (True, True, True), (1, 2): (True, False, False), (1, 3): (False, False, False), (2, 1): (True, False, False)}
    assert rows[1, 1].document_type == "invoice" and rows[1, 1].validation.overall_score > 0 and rows[1, 1].confidence_score == 0.7
    assert rows[1, 2].error == "no model response" and rows[1, 3].error.startswith("extracted_text") and rows[9, 9].analysis_success


def test_versions_are_whole_or_not_there(spark, folder):
    first, broken = spark.range(5), spark.range(5).selectExpr("id", "assert_true(id < 3)")
    schema = "id long"
    assert versions.read_versions(spark, folder + "/t", schema).count() == 0
    assert versions.write_version(first, folder + "/t", "a")
    with pytest.raises(Exception):
        versions.write_version(broken, folder + "/t", "b")
    assert versions.committed(spark, folder + "/t") == ["a"] and versions.read_versions(spark, folder + "/t", schema).count() == 5
    assert versions.write_version(spark.range(7), folder + "/t", "b") and not versions.write_version(spark.range(9), folder + "/t", "b")
    assert versions.read_versions(spark, folder + "/t", schema).count() == 12
    assert versions.read_versions(spark, folder + "/t", schema, latest=True).count() == 7


def test_a_second_run_of_complete_results_keeps_the_table_readable(spark, folder):
    for batch_rows in (page_rows()[:2], page_rows()[2:]):
        arrive(spark, batch_rows, PAGES, folder + "/in")
        parts = streams.stream_parts(streams.stream_pages(spark, folder + "/in", PAGES))
        streams.run_to_table(parts, folder + "/out", folder + "/checkpoint", "complete")
    newest = versions.read_versions(spark, folder + "/out", parts.schema, latest=True)
    rows = {r.doc_id: r for r in results.fold_parts(newest).collect()}
    assert rows[1].extracted_content == "a b" and rows[1].pages_processed == 3 and set(rows) == {1, 2}


def test_last_n_over_a_hot_agent(spark):
    log = spark.range(5000).selectExpr(
        "id AS task_id", "int(id % 3 = 0) AS agent", "timestamp_seconds(id % 100) AS start_ts", "1D AS duration",
        "IF(id % 10 = 0, 'error', 'completed') AS status", "IF(id % 10 = 0, 'e', NULL) AS error", "'t' AS document_type",
    ).repartition(7)
    rows = [tuple(r) for r in log.select("agent", "start_ts", "task_id").collect()]
    expected = set()
    for agent in (0, 1):
        newest = sorted((r for r in rows if r[0] == agent), key=lambda r: r[1:], reverse=True)[:50]
        expected |= {(agent, r[2], n) for n, r in enumerate(newest, 1)}
    assert set(map(tuple, metrics.last_n(log, 50).select("agent", "task_id", "recency").collect())) == expected
    plan = metrics.last_n(log, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_empty_log(spark):
    log = spark.createDataFrame([], "task_id long, agent int, start_ts timestamp, duration double, status string, error string, document_type string")
    totals = metrics.overall_statistics(metrics.agent_status(log)).first()
    assert (totals.total_tasks_processed, totals.overall_success_rate) == (0, 0.0)


def test_positions_are_dense_over_many_ranges(spark):
    rows = spark.range(0, 5000, numPartitions=7).selectExpr("(id * 7919) % 5003 AS doc_id", "id AS n")
    got = {r.doc_id: r.position for r in batch.dense_position(rows.repartition(16), ["doc_id"]).collect()}
    assert got == {d: i for i, d in enumerate(sorted(got))} and len(got) == 5000
    ties = spark.createDataFrame([(1,), (None,), (1,), (0,)], "doc_id long")
    assert sorted((r.doc_id is not None, r.doc_id, r.position) for r in batch.dense_position(ties, ["doc_id"]).collect()) == [(False, None, 0), (True, 0, 1), (True, 1, 2), (True, 1, 3)]
    assert batch.dense_position(ties.limit(0), ["doc_id"]).count() == 0


def test_batch_from_tokens_keeps_every_task(spark):
    tasks = spark.createDataFrame(
        [(3, "/in/c", 1, ".pdf", "invoice", "table", '{"total_amount": "$5.00", "summary": "s"}', 2.0), (1, "", 1, ".pdf", "invoice", "text", "x", None),
         (2, "/in/b", 1, ".pdf", "invoice", "text", '{"total_amount": "$5.00"}', 0.5), (4, "/in/d", 1, ".exe", "auto", "text", "x", 1.0), (5, "/in/e", 1, ".pdf", "auto", "full", None, None)],
        "doc_id long, document_path string, size_bytes long, extension string, requested_type string, extraction_type string, response string, seconds double",
    )
    tokens = spark.createDataFrame(
        [(3, 1, i, t, 0.9, 0.0, float(i)) for i, t in enumerate(["total", "$5.00"])] + [(1, 1, 0, "never read", 0.9, 0.0, 0.0), (5, 1, 0, "LOW", 0.1, 0.0, 0.0)],
        "doc_id long, page int, pos int, text string, confidence double, y_min double, x_min double",
    )
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    end = F.timestamp_micros((F.unix_micros(start) + F.col("seconds") * 1000000).cast("long"))
    rows = {r.doc_id: r for r in batch.process_batch(tasks, documents.AS_OF, start, end, tokens=tokens, order=["document_path"]).collect()}
    assert {d: (r.position, r.document_path, r.success) for d, r in rows.items()} == {1: (0, "", False), 2: (1, "/in/b", True), 3: (2, "/in/c", True), 4: (3, "/in/d", False), 5: (4, "/in/e", True)}
    assert rows[3].result.extraction_results.extracted_text == "total | $5.00" and rows[3].result.extraction_results.extraction_type == "table"
    assert rows[3].result.validation_results.is_valid is not None and rows[3].metrics.processing_time == 2.0
    assert rows[2].result.extraction_results.extracted_text == "" and rows[2].result.validation_results.validation_status == "unknown"
    assert rows[1].error.message == "document_path is required" and rows[1].result is None
    assert rows[4].error.message.startswith("Unsupported") and rows[4].timestamp.duration == 1.0
    assert rows[5].timestamp.duration is None and rows[5].result.extraction_results.extracted_text == ""


def test_a_run_is_observed_while_it_is_written(spark, folder):
    runs = spark.createDataFrame([(True, 1.0, 0.5), (True, 3.0, 0.7), (False, 9.0, None)], "success boolean, processing_time double, confidence double")
    seen_runs, seen = metrics.observe_run(runs)
    seen_runs.write.parquet(folder + "/runs")
    report = metrics.run_report(runs).first().asDict()
    assert {k: v for k, v in report.items() if k != "success_rate"} == pytest.approx(seen.get)
    nothing, seen = metrics.observe_run(runs.limit(0), "none")
    nothing.write.parquet(folder + "/none")
    assert seen.get["total_tests"] == 0 and seen.get["avg_confidence"] is None


def test_cuts_are_parameters(spark):
    from paperlane.functions import prompts

    frame = spark.createDataFrame([("x" * 3000,)], "t string")
    r = frame.selectExpr(
        f"{prompts.prompt(chr(39) + 'entities' + chr(39), 't', entity_chars=17)} AS a",
        f"{prompts.brief_prompt(chr(39) + 'invoice' + chr(39), 't', {'invoice': 19})} AS b",
    ).first()
    assert "x" * 17 in r.a and "x" * 18 not in r.a and "x" * 19 in r.b and "x" * 20 not in r.b
    parts = [F.lit("s"), F.lit("f"), F.lit("d"), F.lit(0.5), F.col("t")]
    md, html = frame.select(writers.render_markdown(*parts, chars=11), writers.render_html(*parts, chars=13)).first()
    assert "x" * 11 in md and "x" * 12 not in md and "x" * 13 in html and "x" * 14 not in html


def _document_tables(spark, folder):
    """The same documents as one file and as a folder of three."""
    rows = [(i, f"INVOICE {i}\n\nTotal: ${i}.50\n\nend", "en", "web", 20) for i in range(1, 40)] + [(40, None, None, None, None)]
    docs = spark.createDataFrame(rows, registry._DOCUMENTS)
    docs.repartition(3).write.parquet(f"{folder}/many/documents.parquet")
    docs.coalesce(1).write.parquet(f"{folder}/single")
    os.mkdir(f"{folder}/one")
    part = next(f for f in os.listdir(f"{folder}/single") if f.endswith(".parquet"))
    os.link(f"{folder}/single/{part}", f"{folder}/one/documents.parquet")
    return f"{folder}/one", f"{folder}/many"


def test_pages_stream_from_a_table_of_several_files(spark, folder):
    one, many = (registry.t1_stream_pages(spark, d).select("doc_id", "page", "error", "document_type") for d in _document_tables(spark, folder))
    assert one.count() == 39 * 3
    assert sorted(one.collect()) == sorted(many.collect())


def test_documents_are_combined_from_a_table_of_several_files(spark, folder):
    one, many = (registry.t2_stream_combine(spark, d) for d in _document_tables(spark, folder))
    assert one.count() == 39
    assert sorted(one.collect()) == sorted(many.collect())


def test_user_code_holds_one_batch_of_rows_at_a_time():
    import pyarrow as pa

    given, schema = pa.RecordBatch.from_pydict({"n": list(range(1000))}), pa.schema([("n", pa.int64()), ("t", pa.string())])
    seen = []

    def work(rows):
        seen.append([r["n"] for r in rows])
        return [{"n": r["n"], "t": "x" * 100_000} for r in rows]

    out = list(userfn._in_turn(iter([given, given]), 5, work, schema))
    assert max(map(len, seen)) == 5 and len(seen) == 400 and max(b.nbytes for b in out) < 2 * userfn.HELD
    assert [n for b in out for n in b.column(0).to_pylist()] == list(range(1000)) * 2


def test_json_runs_take_little_space(spark, folder):
    rows = spark.range(2000).selectExpr("id AS doc_id", "repeat('the same words in each row ', 40) AS text", "string(NULL) AS note")
    assert writers.write_json_run(rows, folder + "/runs", "first")
    files = [os.path.join(d, f) for d, _, names in os.walk(folder + "/runs/versions") for f in names if f.startswith("part-")]
    assert sum(map(os.path.getsize, files)) < 200_000
    read = versions.read_versions(spark, folder + "/runs", rows.schema, "json")
    assert sorted(read.collect()) == sorted(rows.collect())
