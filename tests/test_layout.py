"""Layout against a plain loop over tokens, on pages with every kind of tie and gap."""

import random

import pytest
from pyspark.sql import functions as F

from paperlane.operators import layout


def loop_tables(tokens, table_gap=50, row_gap=30):
    """Cells of one page: groups by vertical gap, rows within, columns from left to right."""
    down = sorted(tokens, key=lambda t: t["y_min"])
    groups, rows = [], {}
    for at, token in enumerate(down):
        gap = None if at == 0 else token["y_min"] - down[at - 1]["y_min"]
        if gap is None or gap >= table_gap:
            groups.append([])
        groups[-1].append(token)
    cells, number = {}, 0
    for group in groups:
        if len(group) < 2:
            continue
        number += 1
        rows = [[group[0]]]
        for before, token in zip(group, group[1:]):
            if token["y_min"] - before["y_min"] >= row_gap:
                rows.append([])
            rows[-1].append(token)
        for row_no, row in enumerate(rows, 1):
            for col_no, token in enumerate(sorted(row, key=lambda t: t["x_min"]), 1):
                cells[token["pos"]] = (number, row_no, col_no)
    return cells


@pytest.fixture(scope="module")
def tokens():
    rng = random.Random(7)
    rows = []
    for doc in range(6):
        for page in range(1, 4):
            for pos in range(rng.randrange(0, 60)):
                y = rng.choice([0, 29, 30, 49, 50, 99, 100, 149, rng.randrange(0, 6000)]) + rng.choice([0.0, 0.5])
                rows.append((doc, page, pos, f"w{pos}", rng.choice([0.79, 0.8, 0.81]), y, float(rng.choice([0, 10, 499, 500, 2500]))))
    return rows


SCHEMA = "doc_id long, page int, pos int, text string, confidence double, y_min double, x_min double"


def test_rows_and_columns(spark, tokens):
    found = layout.group_rows(spark.createDataFrame(tokens, SCHEMA)).collect()
    expected = {}
    names = ["doc_id", "page", "pos", "text", "confidence", "y_min", "x_min"]
    pages = {}
    for row in tokens:
        token = dict(zip(names, row))
        pages.setdefault((token["doc_id"], token["page"]), []).append(token)
    for (doc, page), listed in pages.items():
        for pos, cell in loop_tables(listed).items():
            expected[(doc, page, pos)] = cell
    assert {(r.doc_id, r.page, r.pos): (r.table_no, r.row_no, r.col_no) for r in found} == expected


def test_gap_limits(spark):
    rows = [(1, 1, i, "t", 1.0, float(y), 0.0) for i, y in enumerate([0, 29, 59, 108, 158])]
    found = layout.group_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()
    # gaps 29, 30, 49 stay in the table, 30 and 49 start rows; 50 starts a group of one, which is no table
    assert [(r.pos, r.table_no, r.row_no) for r in found] == [(0, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 3)]


def test_pieces_give_the_same_text(spark, tokens, monkeypatch):
    frame = spark.createDataFrame(tokens, SCHEMA)
    whole = {r.doc_id: (r.extracted_content, r.total_items, r.filtered_items) for r in layout.assemble_text(frame).collect()}
    tables = {r.doc_id: r.extracted_content for r in layout.table_result(frame).collect()}
    monkeypatch.setattr(layout, "PIECE", 3)
    monkeypatch.setattr(layout, "STRETCH", 7)
    again = {r.doc_id: (r.extracted_content, r.total_items, r.filtered_items) for r in layout.assemble_text(frame).collect()}
    assert again == whole
    assert {r.doc_id: r.extracted_content for r in layout.table_result(frame).collect()} == tables
    kept = sorted((t for t in tokens if t[4] >= 0.8), key=lambda t: (t[0], t[1], t[2]))
    for doc, (content, _, n) in whole.items():
        words = [t[3] for t in kept if t[0] == doc]
        assert content == " ".join(words) and n == len(words)


def test_long_documents_are_whole(spark, monkeypatch):
    monkeypatch.setattr(layout, "PIECE", 7)
    rows = [(1, 1 + i // 20, i % 20, f"word{i}", 1.0, 0.0, 0.0) for i in range(50)] + [(2, 1, 0, "word", 1.0, 0.0, 0.0)]
    found = {r.doc_id: r for r in layout.assemble_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].extracted_content == " ".join(f"word{i}" for i in range(50)) and found[1].total_items == 50
    assert found[2].extracted_content == "word"


def test_pages_without_tokens_and_empty_results(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (9, 1)], "doc_id long, page int")
    rows = [(1, 1, 0, " ", 0.5, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("processing_time", F.lit(0.5))
    text = {r.doc_id: r for r in layout.assemble_text(frame, pages=pages).collect()}
    assert (text[1].pages_processed, text[1].extracted_content, text[1].confidence) == (2, "", 0.0)
    assert (text[9].pages_processed, text[9].total_items, text[9].processing_time) == (1, 0, 0.0)
    tables = {r.doc_id: r for r in layout.table_result(frame, pages).collect()}
    assert tables[1].extracted_content == "Found 0 tables across 2 pages, but no text content could be extracted."
    structure = {r.doc_id: r for r in layout.structure_result(frame, pages).collect()}
    assert structure[1].extracted_content == "Extracted structure from 2 pages, but no text content could be extracted."
    assert structure[9].confidence == 0.0


def test_page_time_counts_once(spark):
    rows = [(1, p, i, "t", 1.0, 0.0, 0.0) for p in (1, 2) for i in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("processing_time", F.col("page") * 0.5)
    assert layout.assemble_text(frame).first().processing_time == 1.5


def test_extraction_kinds(spark, tokens):
    frame = spark.createDataFrame(tokens, SCHEMA)
    kinds = {k: layout.extract(frame, k).first().extraction_type for k in ("text", "table", "structure", "full", "other")}
    assert kinds == {"text": "text", "table": "table", "structure": "structure", "full": "full", "other": "text"}


def test_a_crowded_row_is_numbered_in_stretches(spark):
    rng = random.Random(11)
    rows = [(1, 1, i, f"w{i}", 1.0, float(rng.choice([0, 0, 10, 20])), rng.choice([float(rng.randrange(0, 600)), 77.0, 77.25, -3.5])) for i in range(40_000)]
    rows += [(1, 2, i, f"v{i}", 1.0, float(i % 2 * 200), float(i % 7)) for i in range(500)] + [(2, 1, 0, "one", 1.0, 5.0, None), (2, 1, 1, "two", 1.0, 5.0, 3.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.page, r.pos): (r.table_no, r.row_no, r.col_no) for r in layout.group_rows(frame).collect()}
    for doc, page in ((1, 1), (1, 2)):
        listed = [{"pos": p, "y_min": y, "x_min": x} for d, g, p, _, _, y, x in rows if (d, g) == (doc, page)]
        want = loop_tables(listed)
        # tokens of one x keep the order of height, then of recognition
        assert {p: got[doc, page, p] for p in want} == want and len(want) == sum(k[:2] == (doc, page) for k in got)
    assert [got[2, 1, 0], got[2, 1, 1]] == [(1, 1, 1), (1, 1, 2)]
    boxes = layout.table_stretches(frame).where("doc_id = 1 AND page = 1")
    assert boxes.count() < 600 and boxes.agg(F.max("cells_left")).first()[0] > 39_000


def test_scans(spark, folder):
    spark.createDataFrame([(1, 1, 0, "t", 1.0, 0.0, 0.0)], SCHEMA).write.parquet(folder + "/tokens")
    tokens = spark.read.parquet(folder + "/tokens")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(layout.assemble_text(tokens)) == scans(layout.structure_result(tokens)) == 1
    assert scans(layout.group_rows(tokens)) == 2
    assert scans(layout.full_content(tokens)) == 3


def test_each_document_takes_its_own_branch(spark, tokens):
    frame = spark.createDataFrame(tokens, SCHEMA).withColumn("processing_time", F.col("page") * 0.5)
    kinds = ["text", "table", "structure", "full", "other", None, "text"]
    asked = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, extraction_type string")
    got = {r.doc_id: r.extraction for r in layout.extract_each(frame, asked).collect()}
    assert set(got) == set(range(7)) and got[6] is None  # no tokens
    for doc, kind in enumerate(kinds[:6]):
        alone = layout.extract(frame.where(F.col("doc_id") == doc), kind or "text").first()
        found = got[doc]
        assert found.extraction_type == alone.extraction_type
        assert (found.extracted_content, found.pages_processed) == (alone.extracted_content, alone.pages_processed)
        assert (found.confidence, found.processing_time) == pytest.approx((alone.confidence, alone.processing_time))
        assert found.total_tables == (alone.asDict().get("total_tables") if kind != "full" else alone.table_extraction.total_tables)
        assert found.total_elements == alone.asDict().get("total_elements")
    assert layout.extract_each(frame.limit(0), asked).where("extraction IS NOT NULL").count() == 0
