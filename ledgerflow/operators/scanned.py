"""Rows of scanned pages: lines, columns, regions between date anchors, and balances carried from row to row (OCR1-10).

Scanned words come from two passes, a ``primary`` one and one for ``numbers``; both have doc_id, page_number, text, x0, x1,
top, bottom, the primary ones also block, paragraph and line.  Each word goes to the region of the date next to it, whose
borders are the middles between dates; a region is then parsed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import tokens as rules
from ledgerflow.functions.columns import computed
from ledgerflow.functions.dialect import SPARK as S

# Header terms of scanned statements.
ALIASES = {
    "transaction_date": ["date", "txn", "txn date", "transaction date", "trans date", "trans. date", "date of transaction"],
    "value_date": ["value date", "value"],
    "description": ["description", "details", "particulars", "narration", "remarks", "transaction details"],
    "debit": ["debit", "debits", "withdrawal", "withdrawals", "withdraw", "withdraws", "dr"],
    "credit": ["credit", "credits", "deposit", "deposits", "deposit amount", "cr"],
    "balance": ["balance", "closing balance", "available balance"],
    "amount": ["amount", "transaction amount"],
}
# Rows that are totals.
TOTALS = ["BALANCE OUTSTANDING", "TOTAL AMOUNT DUE", "MINIMUM PAYMENT DUE", "STATEMENT BALANCE"]
MONEY = ("debit", "credit", "amount", "balance")
#: Lines above the first dated one that may hold the header; the upper part of a page without transactions.
ABOVE, HEAD = 15, 200.0
#: Dates farther apart are two anchors; one without another within ISOLATED is none; what the outer regions take in.
APART, ISOLATED, BEFORE, AFTER = 18.0, 250.0, 30.0, 130.0
#: A number farther than this from a column is not its value.
FARTHEST = 125.0

_PAGE = ["doc_id", "page_number"]
_MAP = "map(" + ", ".join(f"'{a}', '{role}'" for role, names in ALIASES.items() for a in names) + ")"


def _lines(words: DataFrame) -> DataFrame:
    """Words with ``n``, the number of their line on its page, and ``first``, that of the first line that begins with a date.

    A line counts if it has a text; it lies at its highest word (OCR1).  Windows over a page's words, which are moved once,
    so neither a line nor a page is held in one row; words are tested before they are moved."""
    keys = [*_PAGE, "block", "paragraph", "line"]
    token = F.regexp_extract(F.trim("text"), r"^\S+", 0)
    words = words.select(
        *keys, "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top")), (F.coalesce(F.trim("text"), F.lit("")) != "").alias("says"),
        F.when(_digits("text"), F.expr(rules.scanned_date(S, "trim(text)"))).alias("dated"),
    )
    line = Window.partitionBy(*keys)
    # the line's text begins with the first word that is not blank
    opens = F.first(F.when(F.col("says"), F.struct("text")), ignorenulls=True).over(line.orderBy("x0", "x1", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["text"]
    moved = words.repartition(*_PAGE).withColumn("opens", opens).withColumn("line_top", F.min("top").over(line)).filter("opens is not null")
    begins = F.coalesce(F.when(_digits("opens"), F.expr(rules.begins_with_date(S, "opens"))), F.lit(False))
    placed = moved.withColumn("n", F.dense_rank().over(Window.partitionBy(*_PAGE).orderBy("line_top", "block", "paragraph", "line")))
    return placed.withColumn("first", F.min(F.when(begins, F.col("n"))).over(Window.partitionBy(*_PAGE)))


def regions(words: DataFrame) -> DataFrame:
    """The columns and regions of each page: doc_id, page_number, cols (role to centre), spans of (start, end) (OCR2-3, OCR11).

    Of the ``ABOVE`` lines before the first one that begins with a date, the one that names most fields, three at least, on
    ties the lower.  A field may be one word or two or three in a row; the last mention counts.
    From top to bottom a date is an anchor if it lies below the last one by more than ``APART``; one without another
    within ``ISOLATED`` is dropped.  A region reaches to the middles between its anchor and the next ones.  A page without
    columns or dates has none."""
    ahead = (F.col("n") < F.col("first")) & (F.col("n") >= F.col("first") - ABOVE)
    dated = F.col("dated") & (F.col("top") >= HEAD)
    kept = _lines(words).select(*_PAGE, F.when(ahead, F.col("n")).alias("n"), F.when(ahead, F.struct("x0", "x1", "text")).alias("word"), F.when(dated, F.col("top")).alias("at"))
    found = kept.filter("n is not null or at is not null").groupBy(*_PAGE, "n").agg(F.array_sort(F.collect_list("word")).alias("ws"), F.collect_set("at").alias("tops"))
    found = computed(found, plain="transform(ws, w -> trim(regexp_replace(regexp_replace(lower(w.text), '[^a-z ]', ' '), ' +', ' ')))")
    one = f"transform(ws, (w, i) -> struct(try_element_at({_MAP}, get(plain, i)) as role, (w.x0 + w.x1) / 2 as centre))"
    text = "trim(array_join(slice(plain, i + 1, k), ' '))"
    several = f"flatten(transform(ws, (w, i) -> transform(array(2, 3), k -> if(i + k <= size(ws), struct(try_element_at({_MAP}, {text}) as role, (w.x0 + get(ws, i + k - 1).x1) / 2 as centre), null))))"
    found = computed(found, named=f"filter(concat({one}, {several}), c -> c.role is not null)")
    roles = "array_distinct(transform(named, c -> c.role))"
    found = computed(found, cols=f"map_from_entries(transform({roles}, r -> struct(r as role, element_at(filter(named, c -> c.role = r), -1).centre as centre)))")
    best = F.max_by("cols", F.when(F.size("cols") >= 3, F.struct(F.size("cols"), "n"))).alias("cols")
    pages = found.groupBy(*_PAGE).agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_list("tops")))).alias("every")).filter("cols is not null")
    far = f"aggregate(every, cast(array() as array<double>), (acc, t) -> if(size(acc) = 0 or t - element_at(acc, -1) > {APART}D, concat(acc, array(t)), acc))"
    pages = computed(pages, tops=far)
    near = f"coalesce(t - get(tops, i - 1) <= {ISOLATED}D, false) or coalesce(get(tops, i + 1) - t <= {ISOLATED}D, false)"
    pages = computed(pages, kept=f"filter(tops, (t, i) -> {near})")
    spans = f"transform(kept, (t, i) -> struct(coalesce((get(kept, i - 1) + t) / 2, t - {BEFORE}D) as start, coalesce((t + get(kept, i + 1)) / 2, t + {AFTER}D) as end))"
    return computed(pages, spans=spans).filter("size(spans) > 0").select(*_PAGE, "cols", "spans").dropna(subset=_PAGE)


def _digits(x: str) -> Column:
    """Whether a text holds a digit, as all dates and numbers do."""
    return F.rlike(x, F.lit("[0-9]"))


def _bare(x: str) -> str:
    """A number's text without the marks that scanning leaves (OCR12)."""
    marks = r"[|\\[\\]*\\\\(){};:]"
    return f"trim(replace(regexp_replace(trim({x}), '^{marks}+|{marks}+$', ''), '$', ''))"


def _bare_date(x: str) -> str:
    marks = r"[|\\[\\]*\\\\(){},]"
    return f"regexp_replace(trim({x}), '^{marks}+|{marks}+$', '')"


def description(x: str) -> str:
    """A description with the usual misreadings mended (OCR10)."""
    upper = f"regexp_replace(upper({x}), '[^A-Z0-9%&]+', ' ')"
    has = lambda w: f"array_contains(split(trim({upper}), ' '), '{w}')"
    thanks = f"{has('PAYMENT')} and {has('RECEIVED')} and ({has('THANK')} or {has('YOU')})"
    back = f"contains({upper}, 'CASHBACK') or contains({upper}, 'CASH BACK') or ({has('CBK')} and {has('SPEND')})"
    return f"case when {thanks} then 'PAYMENT RECEIVED, THANK YOU' when {back} then trim(BOTH ' ,:-' FROM {x}) else trim(BOTH ' |[]{{}}' FROM {x}) end"


def scanned_rows(words: DataFrame, numbers: DataFrame) -> DataFrame:
    """Raw rows of scanned pages: doc_id, page_number, position, transaction_date, value_date, description, amount, debit, credit, balance (OCR3-4, OCR9).

    Numbers of both passes that are the same value in nearly the same place are one.  A whole number does not count beside
    a decimal one.  Numbers go to columns by the least distance of all pairs, then of those left.  A page without columns
    or dates gives no rows; totals are none."""
    bare, digits = _bare("text"), "rlike(text, '[0-9]')"
    date, number = (f"coalesce({digits} and {test(S, 'trim(text)')}, false)" for test in (rules.scanned_date, rules.scanned_number))
    clean = "trim(BOTH '|[]{}' FROM trim(text))"
    told = f"source = 0 and trim(text) <> '' and not dated and not (number and rlike({bare}, '^[0-9]')) and upper(trim(text)) not in ('DR', 'CR') and {clean} <> '' and not rlike({clean}, '^[0-9]{{6,}}$')"
    # a word is tested where it stands alone, before words meet by region
    place = lambda df, source: df.select(*_PAGE, "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top")), F.lit(source).alias("source"))
    placed = computed(place(words, 0).unionByName(place(numbers, 1)), dated=f"source = 0 and {date}", number=number)
    placed = computed(placed, date=f"if(dated, {_bare_date('text')}, null)", bare=f"if(number, {bare}, null)", say=f"if({told}, {clean}, null)")
    placed = computed(placed, value="try_cast(replace(bare, ',', '') as double)")
    sound = "value is not null and not rlike(bare, '^((19|20|21)[0-9]{2}|[0-9]{6,})$')"
    number = F.struct("bare", "value", F.expr("rlike(bare, '^[0-9]{1,4}$') and bare <> '0'").alias("short"), F.contains("bare", F.lit(".")).alias("point"))
    placed = placed.select(*_PAGE, "top", "x0", "x1", "source", "text", "date", F.when(F.expr(sound), number).alias("number"), "say").filter("date is not null or number is not null or say is not null")
    # regions travel with the words: each begins before the words at its start, and ends where the next one begins
    spans = regions(words).select(*_PAGE, "cols", F.posexplode("spans").alias("i", "s")).select(*_PAGE, F.col("s.start").alias("top"), F.struct((F.col("i") + 1).alias("region"), "s.end").alias("span"), "cols")
    both = placed.withColumn("word", F.lit(True)).unionByName(spans.withColumn("word", F.lit(False)), allowMissingColumns=True).repartition(*_PAGE)
    placed = both.withColumn("span", F.last("span", ignorenulls=True).over(Window.partitionBy(*_PAGE).orderBy("top", "word").rowsBetween(Window.unboundedPreceding, 0)))
    word = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("top", "x0", "x1", "source", "text", c))))
    inside = placed.filter("top < span.end").withColumn("region", F.col("span.region"))
    rows = inside.groupBy(*_PAGE, "region").agg(word("date").alias("dated"), word("number").alias("numeric"), word("say").alias("said"), F.any_value("cols", ignoreNulls=True).alias("cols")).filter("size(dated) > 0")
    by_x = "(a, b) -> case when a.x0 < b.x0 then -1 when a.x0 > b.x0 then 1 else 0 end"
    rows = computed(rows, dates=f"transform(array_sort(dated, {by_x}), w -> w.date)")
    seen = "transform(numeric, w -> struct(w.top as top, (w.x0 + w.x1) / 2 as centre, w.source as source, w.number.bare as text, w.number.value as value, w.number.short as short, w.number.point as point))"
    rows = computed(rows, seen=seen, money=f"filter(transform(array{MONEY}, r -> struct(r as role, cols[r] as centre)), m -> m.centre is not null)")
    near = f"exists(money, m -> abs(c.centre - m.centre) <= {FARTHEST}D)"
    rows = computed(rows, found=f"filter(seen, c -> not c.short or {near})")
    rows = computed(rows, exact=f"filter(found, c -> c.point and {near})")
    beside = "exists(exact, e -> abs(e.top - c.top) <= 8 and abs(e.centre - c.centre) <= 100)"
    by_top = "(a, b) -> case when a.top < b.top then -1 when a.top > b.top then 1 when a.centre < b.centre then -1 when a.centre > b.centre then 1 when a.source < b.source then -1 when a.source > b.source then 1 else 0 end"
    rows = computed(rows, left=f"array_sort(filter(found, c -> c.point or not {beside}), {by_top})")
    kind = "struct<top: double, centre: double, source: int, text: string, value: double, short: boolean, point: boolean>"
    same = "exists(acc, e -> abs(c.centre - e.centre) < 8 and c.value = e.value and abs(c.top - e.top) < 12)"
    rows = computed(rows, items=f"aggregate(left, cast(array() as array<{kind}>), (acc, c) -> if({same}, acc, concat(acc, array(c))))")
    pairs = f"array_sort(filter(flatten(transform(items, (c, i) -> transform(money, m -> struct(abs(c.centre - m.centre) as d, i as i, m.role as role)))), p -> not coalesce(p.d > {FARTHEST}D, false)))"
    rows = computed(rows, pairs=pairs)
    taken = "exists(acc, t -> t.i = p.i or t.role = p.role) or (p.role <> 'balance' and get(items, p.i).value = 0)"
    rows = computed(rows, placed=f"aggregate(pairs, cast(array() as array<struct<d: double, i: int, role: string>>), (acc, p) -> if({taken}, acc, concat(acc, array(p))))")
    rightmost = "array(get(items, -array_max(transform(items, (c, i) -> struct(c.centre as c, -i as i))).i))"
    rows = computed(rows, right=rightmost, **{f"_{r}": f"get(items, try_element_at(filter(placed, p -> p.role = '{r}'), 1).i).text" for r in MONEY})
    story = "array_join(said.say, ' ')"
    rows = computed(rows, story=f"trim(regexp_replace(regexp_replace({story}, '^\\\\d{{1,2}}-[A-Za-z]{{3,9}}-\\\\d{{2,4}}\\\\s*', ''), '\\\\s+', ' '))")
    last = f"coalesce(_balance, case when abs(try_element_at(right, 1).centre - cols['balance']) <= {FARTHEST}D then try_element_at(right, 1).text end)"
    texts = {"amount": "_amount", "debit": "_debit", "credit": "_credit", "balance": last}
    rows = computed(rows, told=description("story"), **{r: f"try_cast(replace({t}, ',', '') as decimal(18,2))" for r, t in texts.items()})
    totals = " or ".join(f"contains(upper(told), '{t}')" for t in TOTALS)
    rows = computed(rows, stays=f"not ({totals}) and (told <> '' or coalesce(debit, credit, amount) is not null)").filter("stays")
    return rows.select(
        *_PAGE, F.col("region").cast("long").alias("position"), F.expr("dates[0]").alias("transaction_date"), F.expr("get(dates, 1)").alias("value_date"),
        F.expr("if(told = '', 'Unrecognized transaction', told)").alias("description"), "amount", "debit", "credit", "balance",
    )


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Balances in cents, corrected from row to row of each key; only the last balance is kept between rows and batches."""
    key, last = None, None
    for batch in batches:
        docs, pages, parts, moves, printed = (batch.column(c).to_pylist() for c in ("doc_id", "page_number", "part", "move", "printed"))
        out: list[int | None] = []
        for k, move, balance in zip(zip(docs, pages, parts, strict=True), moves, printed, strict=True):
            if k != key:
                key, last = k, None
            if last is not None and move is not None and (balance is None or abs(balance - last - move) > 100):
                balance = last + move
            out.append(balance)
            last = balance if balance is not None else last
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "page_number", "position")), pa.array(out, pa.int64())], ["doc_id", "page_number", "position", "carried"])


def carry_balances(rows: DataFrame) -> DataFrame:
    """Rows of scanned pages with balances that follow from their movements (OCR3, OCR6).

    ``rows``: doc_id, page_number, position, description, amount, debit, credit, balance.  A printed balance that misses the
    last one and the row's debit or credit by more than 1.00, or is missing, becomes what follows; the next row goes on from
    it.  A row with a balance but no debit or credit starts anew, so a long page falls apart into parts that are corrected
    each by itself; its movement is its debit or credit.  An amount alone is one by its wording."""
    order = Window.partitionBy(*_PAGE).orderBy("position")
    move = F.coalesce(-F.col("debit"), F.col("credit"))
    fresh = move.isNull() & F.col("balance").isNotNull()
    parted = rows.withColumn("part", F.sum(fresh.cast("int")).over(order))
    cents = lambda c: (c * 100).cast("long")
    steps = parted.select(*_PAGE, "part", "position", cents(move).alias("move"), cents(F.col("balance")).alias("printed"))
    steps = steps.repartition(*_PAGE, "part").sortWithinPartitions(*_PAGE, "part", "position")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*_PAGE, "position"))
    carried = steps.mapInArrow(_carried, f"{kinds}, carried long")
    out = rows.join(carried, [*_PAGE, "position"]).withColumn("balance", (F.col("carried") / 100).cast("decimal(18,2)"))
    before = F.last("balance", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = computed(out.withColumn("before", before), shift="if(debit is null and credit is null, balance - before, null)", credited=rules.credit_wording(S, "coalesce(description, '')"), debited=rules.debit_wording(S, "coalesce(description, '')"))
    alone = "before is not null and debit is null and credit is null and balance is null and amount is not null"
    opening = "before is null and coalesce(debit, 0) = 0 and coalesce(credit, 0) = 0 and coalesce(amount, 0) = 0 and balance is not null and credited"
    kept = [c for c in rows.columns if c not in ("amount", "debit", "credit", "balance")]
    kind = "decimal(18,2)"
    return out.select(
        *kept,
        F.expr(f"case when not ({alone} and (credited or debited)) then amount end").cast(kind).alias("amount"),
        F.expr(f"case when shift < 0 then -shift when {alone} and debited and not credited then amount else debit end").cast(kind).alias("debit"),
        F.expr(f"case when shift > 0 then shift when {alone} and credited then amount when {opening} then balance else credit end").cast(kind).alias("credit"),
        "balance",
    )


def reconcile_rows(rows: DataFrame) -> DataFrame:
    """Debits and credits mended by consecutive balances, balances derived where none is printed (OCR5).

    A debit or credit that misses the movement of the balance by more than 1.00, or is missing, becomes the movement.  Where
    the balance is missing it follows from the one before and the row's debit, credit or amount (by wording), until a row
    that tells none.  A balance before which none is known changes nothing, but for a first row worded as a credit."""
    order = Window.partitionBy(*_PAGE).orderBy("position")
    told = computed(rows, credited=rules.credit_wording(S, "coalesce(description, '')"), debited=rules.debit_wording(S, "coalesce(description, '')"))
    told = computed(told, move="case when debit is not null then -debit when credit is not null then credit when credited then amount when debited then -amount end")
    told = told.withColumn("part", F.count("balance").over(order))
    within = Window.partitionBy(*_PAGE, "part").orderBy("position")
    told = told.withColumn("sum", F.sum(F.coalesce("balance", "move")).over(within)).withColumn("broken", F.max(F.expr("balance is null and move is null")).over(within))
    told = told.withColumn("now", F.expr("case when balance is not null then balance when part > 0 and not broken then sum end").cast("decimal(18,2)"))
    told = told.withColumn("before", F.lag("now").over(order)).withColumn("first", F.row_number().over(order) == 1)
    derived = "before is not null and balance is null"
    by_words = f"{derived} and debit is null and credit is null and amount is not null"
    told = computed(told, shift="if(before is not null and balance is not null, balance - before, null)")
    off_debit, off_credit = "shift is not null and debit is not null and abs(-debit - shift) > 1", "shift is not null and debit is null and credit is not null and abs(credit - shift) > 1"
    none = "shift is not null and debit is null and credit is null"
    kind = "decimal(18,2)"
    new_debit = F.expr(f"case when {off_debit} then if(shift < 0, -shift, null) when ({off_credit} or {none}) and shift < 0 then -shift when {by_words} and not credited and debited then amount else debit end").cast(kind)
    new_credit = F.expr(f"case when {off_debit} and shift > 0 then shift when {off_credit} then if(shift > 0, shift, null) when {none} and shift > 0 then shift when {by_words} and credited then amount else credit end").cast(kind)
    told = computed(told, d=new_debit, c=new_credit)
    opening = "first and d is null and c is null and now is not null and credited"
    kept = [c for c in rows.columns if c not in ("amount", "debit", "credit", "balance")]
    return told.select(
        *kept,
        F.expr(f"case when (shift is not null and coalesce(d, c) is not null) or ({by_words} and coalesce(d, c) is not null) then null else amount end").cast(kind).alias("amount"),
        F.col("d").alias("debit"), F.expr(f"if({opening}, now, c)").cast(kind).alias("credit"), F.col("now").alias("balance"),
    )


def scanned_statement(words: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows of scanned pages with balances carried and movements reconciled."""
    return reconcile_rows(carry_balances(scanned_rows(words, numbers)))
