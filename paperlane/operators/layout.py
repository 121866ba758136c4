"""Text assembly and layout from recognised tokens.

Tokens: `doc_id`, `page` (from 1), `pos` (order of recognition), `text`,
`confidence`, `y_min`, `x_min`, optionally `processing_time` (of the page).
(page, pos) identifies a token of a document.

A document or a page may hold a large share of all tokens. Sums and counts are
combined before they are shuffled. Ordered work is done in pieces: runs of
positions, stretches of a row, runs of cells; what comes before a piece is known
from the counts of the pieces before it. One summary of the runs of a document holds
counts, sums and texts, so text and structure come out of one pass. Only whole strings are put
together per document, and only where they fit in a value; the pieces of longer documents are available from `text_pieces`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text as texts
from .admission import extraction_branch

KEY = "doc_id"
PIECE = 4096  # tokens, cells or elements put together at once
STRETCH = 8  # width in pixels of the stretches in which the cells of a row are counted


def filter_confidence(tokens: DataFrame, threshold: float = fixed.TOKEN_CONFIDENCE) -> DataFrame:
    return tokens.where(F.col("confidence") >= threshold)


def stamp_page(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Rows of an array of pages with their number, counted from 1."""
    rest = [c for c in documents.columns if c != pages]
    return documents.select(*rest, F.posexplode(pages).alias("_at", "page_content")).select(
        *rest, (F.col("_at") + 1).alias("page"), "page_content"
    )


def _in_order(items: str, name: str) -> str:
    return f"transform(array_sort({items}), s -> s.{name})"


def text_pieces(tokens: DataFrame, order: list[str], piece: Column, text: str, separator: str) -> DataFrame:
    """Texts of a document's pieces: `piece` and `order` sort the tokens, `piece` bounds a group.

    One row per document and piece: `piece`, `text`.
    """
    grouped = tokens.groupBy(KEY, piece.alias("piece")).agg(
        F.collect_list(F.struct(*order, F.expr(text).alias("t"))).alias("items")
    )
    return grouped.select(
        KEY, "piece", F.expr(f"array_join({_in_order('items', 't')}, '{separator}')").alias("text")
    )


_KINDS = ["heading", "title", "paragraph", "text"]


def _run_sums(tokens: DataFrame, threshold: float) -> dict[str, Column]:
    sure = F.col("confidence") >= threshold
    kind = F.expr(texts.classify_element("text"))
    return {
        "total_items": F.count(F.lit(1)),
        "filtered_items": F.count_if(sure),
        "sure_sum": F.sum(F.when(sure, F.col("confidence"))),
        "confidence_sum": F.sum("confidence"),
        **{f"{k}s": F.count_if(kind == k) for k in _KINDS},
    }


_FIGURES = ["total_items", "filtered_items", "sure_sum", "confidence_sum", *[f"{k}s" for k in _KINDS]]


def run_summary(
    tokens: DataFrame, threshold: float, all_text: Column | bool = False, pages: DataFrame | None = None
) -> DataFrame:
    """Counts, sums and texts of every run of positions of a page; summaries of more runs simply add up.

    One row per document, page and `part`: the sums of its tokens, `page_time`, `sure_text` of its sure tokens (NULL without one)
    and, where `all_text` holds, the lines of all of them. `all_text` may differ from
    document to document, so that each carries only the text it needs. `pages` (doc_id, page) also lists pages without tokens.
    """
    wanted = F.lit(all_text) if isinstance(all_text, bool) else all_text
    time = F.col("processing_time") if "processing_time" in tokens.columns else F.lit(0.0)
    kept = tokens.withColumns({"_sure": F.col("confidence") >= threshold, "_all": wanted})
    item = F.when(F.col("_sure") | F.col("_all"), F.struct("pos", "_sure", "text"))
    runs = kept.groupBy(KEY, "page", F.floor(F.col("pos") / PIECE).alias("part")).agg(
        F.max(time).alias("page_time"),
        F.bool_or("_all").alias("_all"),
        F.array_sort(F.collect_list(item)).alias("_items"),
        *[c.alias(n) for n, c in _run_sums(tokens, threshold).items()],
    )
    runs = runs.select(
        KEY, "page", "part", "page_time", *_FIGURES,
        F.expr("IF(filtered_items > 0, array_join(transform(filter(_items, i -> i._sure), i -> i.text), ' '), NULL)").alias("sure_text"),
        F.expr("IF(_all, array_join(transform(_items, i -> i.text), '\\n'), NULL)").alias("all_text"),
    )
    if pages is None:
        return runs
    return runs.unionByName(pages.select(KEY, "page").distinct(), allowMissingColumns=True)


def fold_runs(runs: DataFrame, texts_of: tuple[str, ...] = ("sure_text",)) -> DataFrame:
    """Documents out of their runs: figures, `pages_processed`, `processing_time`, and the named texts in reading order.

    Every run carries its page's recognition time, which counts once.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    grouped = runs.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("page", "part", "page_time", *texts_of))).alias("runs"),
        *[zero(F.sum(n)).alias(n) for n in _FIGURES],
    )
    time = """aggregate(runs, named_struct('page', int(NULL), 'high', 0D, 'done', 0D), (s, r) -> IF(s.page <=> int(r.page),
        named_struct('page', s.page, 'high', greatest(s.high, coalesce(double(r.page_time), 0D)), 'done', s.done),
        named_struct('page', int(r.page), 'high', coalesce(double(r.page_time), 0D), 'done', s.done + s.high)), s -> s.done + s.high)"""
    joined = {
        "sure_text": "array_join(transform(filter(runs, r -> r.sure_text IS NOT NULL), r -> r.sure_text), ' ')",
        "all_text": texts.strip("array_join(transform(filter(runs, r -> r.all_text IS NOT NULL), r -> r.all_text), '\\n')"),
    }
    return grouped.select(
        KEY,
        F.expr("size(array_distinct(transform(runs, r -> r.page)))").alias("pages_processed"),
        F.expr(time).alias("processing_time"),
        *_FIGURES,
        *[F.expr(joined[t]).alias(t) for t in texts_of],
    )


def document_times(tokens: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Pages and recognition time per document, by way of its pages; texts are not read."""
    time = F.col("processing_time") if "processing_time" in tokens.columns else F.lit(0.0)
    by_page = tokens.groupBy(KEY, "page").agg(F.max(time).alias("page_time"))
    if pages is not None:
        by_page = pages.select(KEY, "page").distinct().join(by_page, [KEY, "page"], "left")
    return by_page.groupBy(KEY).agg(
        F.count("page").cast("int").alias("pages_processed"),
        F.coalesce(F.sum("page_time"), F.lit(0)).cast("double").alias("processing_time"),
    )


def _text_columns() -> list[Column]:
    kept = F.col("filtered_items") > 0
    return [
        F.when(kept, F.col("sure_text")).otherwise("").alias("extracted_content"),
        F.col("total_items").cast("int").alias("total_items"),
        F.col("filtered_items").cast("int").alias("filtered_items"),
        F.when(kept, F.col("sure_sum") / F.col("filtered_items")).otherwise(F.lit(0.0)).alias("confidence"),
        F.col("processing_time"),
        F.col("pages_processed"),
        F.lit("text").alias("extraction_type"),
    ]


def assemble_text(
    tokens: DataFrame,
    threshold: float = fixed.TOKEN_CONFIDENCE,
    pages: DataFrame | None = None,
) -> DataFrame:
    """One row per document: text of sure tokens in reading order, counts and mean confidence.

    `total_items` counts all tokens, `filtered_items` the sure ones.
    """
    return fold_runs(run_summary(tokens, threshold, pages=pages)).select(KEY, *_text_columns())


def confidence_scores(tokens: DataFrame, threshold: float = fixed.TOKEN_CONFIDENCE) -> DataFrame:
    """Scores of the sure tokens in reading order, as rows: document, page, pos, score."""
    return filter_confidence(tokens, threshold).select(KEY, "page", "pos", "confidence")


def table_levels(tokens: DataFrame, table_gap: float = fixed.TABLE_GAP, row_gap: float = fixed.ROW_GAP) -> DataFrame:
    """(document, page, y_min) of every height that lies in a table, with its table and row number.

    A vertical gap of `table_gap` or more starts a new group; groups of one
    token are no tables. Within a table a gap of `row_gap` or more starts a row.

    Tokens of one height always stay together, so gaps are a matter of heights:
    tokens are first counted per height, which leaves a page at most as many
    rows as it has pixel lines, however many tokens it holds.
    """
    levels = tokens.groupBy(KEY, "page", "y_min").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(KEY, "page").orderBy("y_min")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(KEY, "page", "group_no")
    gap = F.coalesce(F.col("y_min") - F.lag("y_min").over(down), F.lit(float("inf")))
    starts = lambda limit: (F.col("gap") >= limit).cast("int")
    grouped = (
        levels.withColumn("gap", gap)
        .withColumns({"group_no": F.sum(starts(table_gap)).over(so_far), "row_at": F.sum(starts(row_gap)).over(so_far)})
        .withColumns({"tokens": F.sum("n").over(group), "first_row": F.min("row_at").over(group)})
        .where(F.col("tokens") > 1)
    )
    numbered = grouped.withColumn("table_no", F.dense_rank().over(Window.partitionBy(KEY, "page").orderBy("group_no")))
    return numbered.select(
        KEY, "page", "y_min", "table_no", (F.col("row_at") - F.col("first_row") + 1).cast("int").alias("row_no")
    )


def segment_tables(tokens: DataFrame, table_gap: float = fixed.TABLE_GAP, row_gap: float = fixed.ROW_GAP) -> DataFrame:
    """Tokens that lie in a table, with page-wise table number and row number; all confidences count."""
    return tokens.join(table_levels(tokens, table_gap, row_gap), [KEY, "page", "y_min"])


def _stretch() -> Column:
    return F.coalesce(F.floor(F.col("x_min") / STRETCH), F.lit(-(1 << 40)))


def table_stretches(tokens: DataFrame, table_gap: float = fixed.TABLE_GAP, row_gap: float = fixed.ROW_GAP) -> DataFrame:
    """What `table_levels` gives, for every stretch of a height, with the number of cells of its row further left.

    Tokens are first counted per height and stretch of `STRETCH` pixels. A page then has at most as many rows as it has
    such boxes, and gaps, tables, rows and the cells before a stretch are all prefix sums over these counts.
    """
    boxes = tokens.groupBy(KEY, "page", "y_min", _stretch().alias("stretch")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(KEY, "page").orderBy("y_min", "stretch")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(KEY, "page", "group_no")
    left = Window.partitionBy(KEY, "page", "group_no", "row_at").orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col("y_min") - F.lag("y_min").over(down), F.lit(float("inf")))
    starts = lambda limit: (F.col("gap") >= limit).cast("int")
    grouped = (
        boxes.withColumn("gap", gap)
        .withColumns({"group_no": F.sum(starts(table_gap)).over(so_far), "row_at": F.sum(starts(row_gap)).over(so_far)})
        .withColumns({"tokens": F.sum("n").over(group), "first_row": F.min("row_at").over(group)})
        .where(F.col("tokens") > 1)
    )
    numbered = grouped.withColumns(
        {
            "table_no": F.dense_rank().over(Window.partitionBy(KEY, "page").orderBy("group_no")),
            "cells_left": F.coalesce(F.sum("n").over(left), F.lit(0)),
        }
    )
    row_no = (F.col("row_at") - F.col("first_row") + 1).cast("int").alias("row_no")
    return numbered.select(KEY, "page", "y_min", "stretch", "table_no", row_no, "cells_left")


def group_rows(tokens: DataFrame, table_gap: float = fixed.TABLE_GAP, row_gap: float = fixed.ROW_GAP) -> DataFrame:
    """Cells of all tables: table, row and column number, columns ordered from left to right.

    Only the tokens of one stretch of a row are put in order against each other; a crowded row is spread over
    as many tasks as it has stretches.
    """
    boxes = table_stretches(tokens, table_gap, row_gap)
    cells = tokens.withColumn("stretch", _stretch()).join(boxes, [KEY, "page", "y_min", "stretch"])
    within = Window.partitionBy(KEY, "page", "table_no", "row_no", "stretch").orderBy("x_min", "y_min", "pos")
    numbered = cells.withColumn("col_no", (F.col("cells_left") + F.row_number().over(within)).cast("int"))
    return numbered.select(*tokens.columns, "table_no", "row_no", "col_no")


def render_tables(cells: DataFrame) -> DataFrame:
    """`table_text` and number of `tables` per document: cells joined by a bar, rows on lines, a blank line between tables.

    Every cell carries the break before it, so pieces are simply concatenated.
    """
    first_cell = F.col("col_no") == 1
    first_of_table = first_cell & (F.col("row_no") == 1)
    lead = F.when(first_of_table, "\n\n").when(first_cell, "\n").otherwise(" | ")
    piece = F.struct("page", "table_no", "row_no", F.floor((F.col("col_no") - 1) / PIECE).alias("part"))
    pieces = cells.groupBy(KEY, piece.alias("piece")).agg(
        F.collect_list(F.struct("col_no", F.concat(lead, "text").alias("led"))).alias("items"),
        F.count_if(first_of_table).alias("tables"),
    )
    pieces = pieces.select(KEY, "piece", "tables", F.expr(f"array_join({_in_order('items', 'led')}, '')").alias("text"))
    joined = pieces.groupBy(KEY).agg(
        F.collect_list(F.struct("piece", "text")).alias("items"), F.sum("tables").cast("int").alias("tables")
    )
    whole = joined.select(KEY, "tables", F.expr(f"array_join({_in_order('items', 'text')}, '')").alias("content"))
    return whole.select(KEY, "tables", F.expr(texts.strip("content")).alias("table_text"))


def _table_columns() -> list[Column]:
    number = F.coalesce("tables", F.lit(0))
    note = F.concat(
        F.lit("Found "), number.cast("string"), F.lit(" tables across "), F.col("pages_processed").cast("string"),
        F.lit(" pages, but no text content could be extracted."),
    )
    return [
        F.coalesce(F.nullif("table_text", F.lit("")), note).alias("extracted_content"),
        number.alias("total_tables"),
        F.col("pages_processed"),
        F.col("processing_time"),
        F.lit(fixed.TABLE_CONFIDENCE).alias("confidence"),
        F.lit("table").alias("extraction_type"),
    ]


def table_result(tokens: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per document: rendered tables, their number, fixed confidence."""
    rendered = render_tables(group_rows(tokens))
    return document_times(tokens, pages).join(rendered, KEY, "left").select(KEY, *_table_columns())


def structure_elements(tokens: DataFrame) -> DataFrame:
    """Every token with the kind of element it looks like."""
    return tokens.withColumn("element_type", F.expr(texts.classify_element("text")))


def _structure_columns() -> list[Column]:
    note = F.concat(
        F.lit("Extracted structure from "), F.col("pages_processed").cast("string"),
        F.lit(" pages, but no text content could be extracted."),
    )
    return [
        F.coalesce(F.nullif("all_text", F.lit("")), note).alias("extracted_content"),
        F.col("total_items").cast("int").alias("total_elements"),
        *[F.col(f"{k}s").cast("int").alias(f"{k}s") for k in _KINDS],
        F.col("pages_processed"),
        F.col("processing_time"),
        F.coalesce(F.try_divide("confidence_sum", "total_items"), F.lit(0.0)).alias("confidence"),
        F.lit("structure").alias("extraction_type"),
    ]


def structure_result(tokens: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per document: all tokens as lines, counts per element type, mean confidence."""
    runs = run_summary(tokens, 0.0, True, pages)
    return fold_runs(runs, ("all_text",)).select(KEY, *_structure_columns())


def full_content(
    tokens: DataFrame,
    threshold: float = fixed.TOKEN_CONFIDENCE,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Text, tables and structure of a document side by side: one summary of its runs beside its tables."""
    runs = run_summary(tokens, threshold, True, pages)
    joined = fold_runs(runs, ("sure_text", "all_text")).join(render_tables(group_rows(tokens)), KEY, "left")
    parts = joined.select(
        KEY,
        "pages_processed",
        F.struct(*_text_columns()).alias("text_extraction"),
        F.struct(*_table_columns()).alias("table_extraction"),
        F.struct(*_structure_columns()).alias("structure_extraction"),
    )
    three = lambda name: " + ".join(f"{p}_extraction.{name}" for p in ("text", "table", "structure"))
    return parts.select(
        KEY,
        F.col("text_extraction.extracted_content").alias("extracted_content"),
        "text_extraction",
        "table_extraction",
        "structure_extraction",
        F.expr(
            "text_extraction.filtered_items + table_extraction.total_tables + structure_extraction.total_elements"
        ).alias("total_elements"),
        F.expr(three("processing_time")).alias("processing_time"),
        "pages_processed",
        F.expr(f"({three('confidence')}) / 3").alias("confidence"),
        F.lit("full").alias("extraction_type"),
    )


def extract(tokens: DataFrame, extraction_type: str = "text", **options) -> DataFrame:
    """The result of one kind of extraction; only its branch is planned, an unknown kind means text."""
    branches = {"table": table_result, "structure": structure_result, "full": full_content}
    return branches.get(extraction_type, assemble_text)(tokens, **options)


def extract_each(
    tokens: DataFrame, asked: DataFrame, threshold: float = fixed.TOKEN_CONFIDENCE, extraction_type: str = "extraction_type"
) -> DataFrame:
    """One `extraction` struct per document of `asked`, each by the branch that its own `extraction_type` names.

    All branches share one summary of runs, which holds only the text that a document's branch gives back; only the
    documents that ask for tables are laid out. Unknown types mean text. A document without tokens has a NULL extraction.
    """
    kinds = asked.select(KEY, F.expr(extraction_branch(extraction_type)).alias("branch"))
    routed = tokens.join(kinds, KEY)
    runs = run_summary(routed, threshold, F.col("branch") == "structure")
    tabled = tokens.join(kinds.where("branch IN ('table', 'full')").select(KEY), KEY, "left_semi")
    joined = (
        kinds.join(fold_runs(runs, ("sure_text", "all_text")), KEY, "left")
        .join(render_tables(group_rows(tabled)), KEY, "left")
        .select(
            KEY,
            "branch",
            F.struct(*_text_columns()).alias("text"),
            F.struct(*_table_columns()).alias("table"),
            F.struct(*_structure_columns()).alias("structure"),
        )
    )
    three = lambda name: f"(text.{name} + table.{name} + structure.{name})"
    chosen = lambda name: (
        f"CASE branch WHEN 'table' THEN table.{name} WHEN 'structure' THEN structure.{name} ELSE text.{name} END"
    )
    members = {
        "extracted_content": chosen("extracted_content"),
        "confidence": f"IF(branch = 'full', {three('confidence')} / 3, {chosen('confidence')})",
        "pages_processed": "text.pages_processed",
        "processing_time": f"IF(branch = 'full', {three('processing_time')}, text.processing_time)",
        "extraction_type": "branch",
        "total_items": "text.total_items",
        "filtered_items": "text.filtered_items",
        "total_tables": "IF(branch IN ('table', 'full'), table.total_tables, NULL)",
        "total_elements": "CASE branch WHEN 'structure' THEN structure.total_elements WHEN 'full' "
        "THEN text.filtered_items + table.total_tables + structure.total_elements END",
    }
    packed = ", ".join(f"'{n}', {e}" for n, e in members.items())
    return joined.selectExpr(KEY, f"IF(text.pages_processed IS NULL, NULL, named_struct({packed})) AS extraction")


def overall_extraction_confidence(mean_score: str, confidence: str) -> str:
    """Mean of the mean token score and the stated confidence, whichever are there; 0.8 if neither is."""
    return (
        f"CASE WHEN {mean_score} IS NULL AND {confidence} IS NULL THEN 0.8D "
        f"WHEN {mean_score} IS NULL THEN {confidence} WHEN {confidence} IS NULL THEN {mean_score} "
        f"ELSE ({mean_score} + {confidence}) / 2 END"
    )
