"""Positioned words to rows and columns, header mapping, text-line statements, document metadata.

Words have doc_id, page_number, text, x0, x1, top, bottom.  A page is the unit of layout: its words are few, so they
meet as one sorted array, and everything before and after stays relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import classify, values
from ledgerflow.functions.columns import computed
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.functions.headers import PHRASES, exact_role
from ledgerflow.functions.vocabulary import BANK_SIGNALS, CARD_SIGNALS
from ledgerflow.operators.regions import physical_rows

WORDS = "doc_id string, page_number int, text string, x0 double, x1 double, top double, bottom double"

def page_rows(words: DataFrame, tolerance: float = 4.0, running_mean: bool = False) -> DataFrame:
    """Add ``row``: the physical row of each word on its page (LAY1, HLP2).

    Words are taken from top to bottom; one joins the row at hand if it lies within ``tolerance`` of the row's first word
    (or, with ``running_mean``, of the mean of its words).  A chain of small gaps is therefore not one row.
    """
    rows = physical_rows(words, tolerance, running_mean)
    return rows.select("doc_id", "page_number", "row", F.explode("tokens").alias("w")).select("doc_id", "page_number", "w.text", "w.x0", "w.x1", "w.top", "w.bottom", "row")


def row_texts(rows: DataFrame) -> DataFrame:
    """The text of each physical row, words from left to right (OCR1, LAY2)."""
    ordered = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return rows.groupBy("doc_id", "page_number", "row").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("line"), F.min("top").alias("top"))


def _with_roles(rows: DataFrame) -> DataFrame:
    """Add ``role`` and ``end`` to words that read as a header, alone or with the next one on their row (HDR9)."""
    order = Window.partitionBy("doc_id", "page_number", "row").orderBy("x0")
    after, gap = F.lead("text").over(order), F.lead("x0").over(order) - F.col("x1")
    both = F.when(gap <= 25, exact_role(F.concat_ws(" ", "text", after)))
    found = rows.withColumn("pair", both).withColumn("end", F.when(both.isNotNull(), F.lead("x1").over(order)).otherwise(F.col("x1")))
    return found.withColumn("role", F.coalesce("pair", F.when(F.lag("pair").over(order).isNull(), exact_role(F.col("text"))))).drop("pair")


def _with_header(rows: DataFrame) -> DataFrame:
    """Add the roles of words and ``header``: the row of their page with most roles, three at least, the first on ties."""
    line, page = Window.partitionBy("doc_id", "page_number", "row"), Window.partitionBy("doc_id", "page_number")
    found = _with_roles(rows).withColumn("_roles", F.size(F.collect_set("role").over(line)))
    best = F.max(F.when(F.col("_roles") >= 3, F.struct("_roles", (-F.col("row")).alias("first")))).over(page)
    return found.withColumn("header", -best["first"]).drop("_roles")


def detect_columns(rows: DataFrame) -> DataFrame:
    """The header row of each page - the one with most roles, the first on ties - as columns with role and extent (STR1, STR3, STR9, HDR9).

    A header may be one word or two next to each other; roles must be three or more."""
    return _with_header(rows).filter("row = header and role is not null").select("doc_id", "page_number", "row", "role", "x0", F.col("end").alias("x1"), "top")


def assign_columns(rows: DataFrame) -> DataFrame:
    """Each word below its page's header with the role of the nearest column centre (JN11, LAY3-5).

    Words come by page from ``page_rows``: header and columns are windows over that partitioning, so no word is moved
    again.  Words of a page without a header, or above it, are left out."""
    column = F.struct(((F.col("x0") + F.col("end")) / 2).alias("c"), "role")
    heads = F.collect_list(F.when((F.col("row") == F.col("header")) & F.col("role").isNotNull(), column)).over(Window.partitionBy("doc_id", "page_number"))
    centre = (F.col("x0") + F.col("x1")) / 2
    nearest = F.array_min(F.transform("cols", lambda c: F.struct(F.abs(c["c"] - centre).alias("d"), c["role"].alias("role"))))["role"]
    below = _with_header(rows).withColumn("cols", heads).filter(F.col("row") > F.col("header"))
    return below.select("doc_id", "page_number", "row", "text", "x0", nearest.alias("role"))


def raw_rows(words: DataFrame) -> DataFrame:
    """Raw statement rows from positioned words: one column per role, rows without a date continue the description (LAY4, JN9-10)."""
    cells = assign_columns(page_rows(words))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    lines = cells.groupBy("doc_id", "page_number", "row").pivot("role", list(PHRASES)).agg(text)
    order = Window.partitionBy("doc_id", "page_number").orderBy("row")
    opened = F.sum(F.when(F.col("balance").isNotNull() | F.col("amount").isNotNull() | F.col("debit").isNotNull() | F.col("credit").isNotNull(), 1).otherwise(0)).over(order)
    date = F.last(F.coalesce("transaction_date", "posting_date"), ignorenulls=True).over(order)
    grouped = lines.withColumn("entry", opened).withColumn("inherited", date).filter("entry > 0").groupBy("doc_id", "page_number", "entry")
    first = [F.first(c, ignorenulls=True).alias(c) for c in PHRASES if c != "description"]
    story = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "description"))), lambda r: r["description"]), " ")
    return grouped.agg(story.alias("description"), F.first("inherited").alias("inherited"), *first).withColumn("transaction_date", F.coalesce("transaction_date", "inherited")).drop("inherited")


def validate_columns(cells: DataFrame, samples: int = 25) -> DataFrame:
    """Share of each column's first values that look like its role; valid from 0.60 on (STV1-9).

    ``cells``: header, role, position, value."""
    kept = cells.filter("nullif(trim(value), '') is not null").withColumn("r", F.row_number().over(Window.partitionBy("header", "role").orderBy("position"))).filter(F.col("r") <= samples)
    date = F.col("value").rlike(r"^\s*(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}[ -]?[A-Za-z]{3,9}([ -]?\d{2,4})?)\s*$")
    number = F.expr(values.parsed_amount(S, "value")).isNotNull() & F.col("value").rlike(r"^[\s(]*[-+]?[^A-Za-z]*\d[\d,.]*\)?\s*([CcDd][Rr])?\s*$")
    ok = F.when(F.col("role").endswith("date"), date).when(F.col("role").isin("debit", "credit", "amount", "balance"), number).otherwise(~date & ~number)
    out = kept.groupBy("header", "role").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 4).alias("score"))
    return out.withColumn("valid", F.col("score") >= 0.6)


_LINE = r"^(\d{1,2} [A-Z]{3}|\d{2}/\d{2}/\d{4}) (\d{1,2} [A-Z]{3}|\d{2}/\d{2}/\d{4}) (.+?) (-?[\d,]+\.\d{2}(?:CR|DR)?)$"


def text_transactions(pages: DataFrame, year: int) -> DataFrame:
    """Transactions on lines with two dates, a description and an amount at the end (LAY25-27)."""
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_number", "line")).withColumn("line", F.trim("line"))
    rows = lines.filter(F.col("line").rlike(_LINE))
    for i, name in enumerate(("d1", "d2", "description_raw", "amount_text"), 1):
        rows = rows.withColumn(name, F.regexp_extract("line", _LINE, i))
    return rows.select(
        "doc_id", "page_number", "line_number", F.expr(values.parsed_date(S, "d1", str(year))).alias("transaction_date"), F.expr(values.parsed_date(S, "d2", str(year))).alias("posting_date"),
        "description_raw", F.expr(values.parsed_amount(S, "amount_text")).alias("amount"), F.when(F.expr(values.marked_credit(S, "amount_text")), "credit").otherwise("debit").alias("direction"),
    )


def raw_text_rows(pages: DataFrame) -> DataFrame:
    """Raw rows (``canonical.RAW_ROWS``) of the lines with two dates, a description and an amount: the later steps parse them.

    The position of a row follows page and line; a page has fewer than 100,000 lines."""
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    # one match gives all parts: neither a line nor a part holds a line feed
    lines = computed(lines, parts=F.split(F.regexp_replace(F.trim("line"), _LINE + r"[\s\S]*", "$1\n$2\n$3\n$4"), "\n")).filter("size(parts) = 4")
    part = lambda i: F.get("parts", i - 1)
    none = F.lit(None).cast("string")
    return lines.select(
        F.col("doc_id").alias("statement_id"), "page_number", (F.col("page_number").cast("long") * 100_000 + F.col("n")).alias("position"), part(1).alias("transaction_date"), part(2).alias("posting_date"),
        none.alias("value_date"), part(3).alias("description"), part(4).alias("amount"), none.alias("debit"), none.alias("credit"), none.alias("balance"), none.alias("transaction_id"), F.col("doc_id").alias("source_file"),
    )


_OPENS = r"^\s*\d{2}[-/]\d{2}[-/]\d{4}"
_CLOSES = r"^(.*?) ([\d,]+\.\d{2}) ([\d,]+\.\d{2}) ?(CR|DR)?$"


def multiline_transactions(pages: DataFrame) -> DataFrame:
    """Transactions that open with a date line, go on over lines and end with amount and balance (LAY28-33)."""
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    lines = lines.filter(~F.expr(classify.is_metadata(S, "line")))
    entry = F.sum(F.when(F.col("line").rlike(_OPENS), 1).otherwise(0)).over(Window.partitionBy("doc_id", "page_number").orderBy("line_number"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda r: r["line"]), " ")
    rows = lines.withColumn("entry", entry).filter("entry > 0").groupBy("doc_id", "page_number", "entry").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("story"))
    rows = rows.filter(F.col("story").rlike(_CLOSES))
    part = lambda i: F.regexp_extract("story", _CLOSES, i)
    rows = rows.select("doc_id", "page_number", "entry", part(1).alias("s"), part(2).alias("a"), part(3).alias("b"))
    rows = rows.withColumn("date_text", F.regexp_extract("s", _OPENS, 0)).withColumn("description_raw", F.trim(F.regexp_replace("s", _OPENS, "")))
    return rows.select(
        "doc_id", "page_number", "entry", F.expr(values.parsed_date(S, "date_text")).alias("transaction_date"), "description_raw", F.expr(values.parsed_amount(S, "a")).alias("amount"),
        F.expr(values.parsed_amount(S, "b")).alias("running_balance"), F.expr(classify.direction(S, "concat(' ', description_raw, ' ')")).alias("direction"),
    )


def document_metadata(pages: DataFrame, first: int = 6) -> DataFrame:
    """Kind, currency and scores of each document from its first pages, from all of them where those leave it open (DOC1-4).

    Scores are taken per page and summed, so a document's text never has to meet in one place."""
    low = F.lower(F.regexp_replace(F.translate("text", " ​", " "), r"\s+", " "))
    head = F.col("page_number") <= first
    rows = pages.select("doc_id", "page_number", "text", low.alias("low"))
    every = lambda signals: [F.max(F.when(F.contains("low", F.lit(s)), w).otherwise(0)) for s, w in signals.items()]
    total = lambda cols: sum(cols, F.lit(0))
    out = rows.groupBy("doc_id").agg(
        total([F.max(F.when(F.contains("low", F.lit(s)) & head, w).otherwise(0)) for s, w in CARD_SIGNALS.items()]).alias("card_head"),
        total([F.max(F.when(F.contains("low", F.lit(s)) & head, w).otherwise(0)) for s, w in BANK_SIGNALS.items()]).alias("bank_head"),
        total(every(CARD_SIGNALS)).alias("card_all"),
        total(every(BANK_SIGNALS)).alias("bank_all"),
        F.min_by(F.expr(classify.currency(S, "text")), F.struct((F.expr(classify.currency(S, "text")) == "UNKNOWN").alias("u"), "page_number")).alias("currency"),
        F.count(F.lit(1)).alias("pages"),
    )
    open_ = (F.col("card_head") == 0) & (F.col("bank_head") == 0)
    card, bank = F.when(open_, F.col("card_all")).otherwise(F.col("card_head")), F.when(open_, F.col("bank_all")).otherwise(F.col("bank_head"))
    kind = F.when((card == 0) & (bank == 0), "unknown").when(card > bank, "credit_card").otherwise("bank_account")
    return out.select("doc_id", card.alias("card_score"), bank.alias("bank_score"), kind.alias("statement_type"), "currency", "pages")


def document_text(pages: DataFrame) -> DataFrame:
    """Whole text of each document with a line before each page (SRC12)."""
    page = F.concat(F.lit("--- page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", page.alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("pages"), F.bool_or(F.length(F.trim("text")) > 0).alias("has_text"))


def reconcile_balances(rows: DataFrame) -> DataFrame:
    """Debit or credit of each row by the movement of printed balances where they disagree by more than 1.00 (OCR5-6).

    ``rows``: doc_id, position, debit, credit, balance.  The single-step part of the rule: each row against the printed
    balance before it, so a statement needs one window and no sequential pass."""
    move = F.col("balance") - F.lag("balance").over(Window.partitionBy("doc_id").orderBy("position"))
    known = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    wrong = move.isNotNull() & (F.abs(move - known) > 1)
    return rows.withColumn("_move", move).select(
        "doc_id", "position", "balance",
        F.when(wrong, F.when(F.col("_move") < 0, -F.col("_move"))).otherwise(F.col("debit")).alias("debit"),
        F.when(wrong, F.when(F.col("_move") >= 0, F.col("_move"))).otherwise(F.col("credit")).alias("credit"),
        wrong.alias("corrected"),
    )
