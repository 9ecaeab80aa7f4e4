"""Layout queries: orders printed as positioned words, and SQL that finds the rows another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.dialect import DUCKDB as D
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.functions.dialect import Dialect
from ledgerflow.operators import generic_rows, metadata, regions, scanned, structure
from ledgerflow.plans.adapters import HEADERS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORD = "struct<text: string, x0: double, x1: double, top: double, bottom: double>"


def _words(rows: DataFrame, tokens: list[tuple[str, str, str]], doc: str = "cast(o_custkey as string)", page: str = "1", top: str = "line * 12.0") -> DataFrame:
    """Positioned words of ``rows``: tokens of (text, left end, right end), where the text is not null."""
    each = F.array(*[F.struct(F.expr(t).alias("text"), F.expr(f"cast({a} as double)").alias("x0"), F.expr(f"cast({b} as double)").alias("x1")) for t, a, b in tokens])
    words = rows.select(F.expr(doc).alias("doc_id"), F.expr(page).cast("int").alias("page_number"), F.expr(top).cast("double").alias("top"), F.explode(each).alias("w"))
    return words.select("doc_id", "page_number", "w.*", "top", (F.col("top") + 8).alias("bottom")).filter("text is not null")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("line", F.expr("row_number() over (partition by o_custkey order by o_orderkey)"))


# ordered_rows: amount, balance and a stray number drift to either side of their columns; half of the statements have one
# column of amounts, and their rows more numbers than columns
AMOUNT_CENTRE = "case when o_custkey % 2 = 0 then 370 when o_orderstatus = 'P' then 420 else 320 end + (o_orderkey * 37) % 121 - 60"
BALANCE_CENTRE = "520 + (o_orderkey * 53) % 141 - 90"
NUMBER_COLUMNS = {True: [("amount", 370.0), ("balance", 520.0)], False: [("debit", 320.0), ("credit", 420.0), ("balance", 520.0)]}


def _printed(d: Dialect) -> dict[str, str]:
    """Texts of a line; null where it has none."""
    day = lambda spark, duck: f"date_format(o_orderdate, '{spark}')" if d.spark else f"strftime(o_orderdate, '{duck}')"
    key = d.padded("o_orderkey", 7)
    return {
        "date": f"case when o_orderkey % 2 = 0 then {day('dd/MM/yyyy', '%d/%m/%Y')} end",
        "day": f"case when o_orderkey % 2 = 1 then {day('dd', '%d')} end",
        "month": f"case when o_orderkey % 2 = 1 then upper({day('MMM', '%b')}) end",
        "value": f"case when o_orderkey % 8 <> 0 then {day('dd/MM/yyyy', '%d/%m/%Y')} end",
        "marker": "case when o_orderkey % 3 = 0 then 'TFR' end",
        "reference": f"concat('S', {key})",
        "stray": "case when o_orderkey % 5 = 0 then '77' end",
        "amount": d.money("cast(o_totalprice as decimal(18,2))"),
        "balance": f"case when o_orderkey % 6 <> 0 then {d.money('cast(o_totalprice * 2 as decimal(18,2))')} end",
    }


def _ordered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _printed(S)
    at = lambda centre: (f"{centre} - 20", f"{centre} + 20")
    tokens = [
        (t["date"], "20", "60"), (t["day"], "20", "32"), (t["month"], "34", "60"), (t["value"], "80", "120"), ("'ORDER'", "140", "180"), (t["marker"], "185", "200"), (t["reference"], "205", "235"),
        (t["stray"], *at("262")), (t["amount"], *at(AMOUNT_CENTRE)), (t["balance"], *at(BALANCE_CENTRE)),
    ]
    return _words(_orders(spark, sf_dir), tokens, top="line * 12.0 + o_orderkey % 3")


def _ordered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = [("transaction_date", 40.0), ("value_date", 100.0), ("description", 160.0), ("transaction_id", 220.0)]
    column = lambda role, centre: F.struct(F.lit(role).alias("role"), F.lit(centre - 20).alias("x0"), F.lit(centre + 20).alias("x1"))
    of = {one: F.array(*[column(*c) for c in shared + cols]) for one, cols in NUMBER_COLUMNS.items()}
    docs = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return docs.select(F.col("o_custkey").cast("string").alias("doc_id"), F.explode(F.when(F.col("o_custkey") % 2 == 0, of[True]).otherwise(of[False])).alias("c")).select("doc_id", "c.*")


def _ordered_sql() -> str:
    """Every choice of columns for the numbers, or of numbers for the columns, one by one."""
    t = _printed(D)
    structs = lambda cols: "[" + ", ".join(f"{{'c': {c}, 'r': '{r}'}}" for r, c in cols) + "]"
    number = lambda text, centre: f"case when {text} is not null then {{'c': cast({centre} as double), 't': {text}}} end"
    pairs = "case when len(nums) <= len(cols) then [{'v': i + 1, 'k': pick[i + 1] + 1} for i in range(0, len(nums))] else [{'v': pick[i + 1] + 1, 'k': i + 1} for i in range(0, len(cols))] end"
    role = lambda r: f"cast(replace([nums[p.v].t for p in pairs if cols[p.k].r = '{r}'][1], ',', '') as double)"
    return f"""
    with lines as (select cast(o_custkey as varchar) as doc_id, o_orderkey, coalesce({t['date']}, {t['day']} || ' ' || {t['month']}) as transaction_date, {t['value']} as value_date,
        coalesce({t['marker']} || ' ', '') || {t['reference']} as transaction_id,
        list_sort([x for x in [{number(t['stray'], '262')}, {number(t['amount'], AMOUNT_CENTRE)}, {number(t['balance'], BALANCE_CENTRE)}] if x is not null]) as nums,
        case when o_custkey % 2 = 0 then {structs(NUMBER_COLUMNS[True])} else {structs(NUMBER_COLUMNS[False])} end as cols from orders),
      picks as (select *, [i for i in range(0, greatest(len(nums), len(cols))) if (mask >> i) & 1 = 1] as pick from lines, (select unnest(range(0, 8)) as mask)
        where bit_count(mask) = least(len(nums), len(cols)) and mask < 2 ** greatest(len(nums), len(cols))),
      choices as (select *, {pairs} as pairs from picks),
      priced as (select *, [abs(nums[p.v].c - cols[p.k].c) for p in pairs] as apart from choices),
      best as (select doc_id, o_orderkey, any_value(transaction_date) as transaction_date, any_value(value_date) as value_date, any_value(transaction_id) as transaction_id, any_value(nums) as nums,
        any_value(cols) as cols, arg_min(pairs, (list_sum(apart), pick)) as pairs from priced where list_max(apart) <= 150 group by 1, 2),
      named as (select *, {role('amount')} as amount, {role('debit')} as debit, {role('credit')} as credit, {role('balance')} as balance from best)
    select doc_id, transaction_date, value_date, array_to_string(list_concat(['ORDER'], [nums[i + 1].t for i in range(0, len(nums)) if not list_contains([p.v for p in pairs], i + 1)]), ' ') as description,
      amount, debit, credit, balance, transaction_id from named where value_date is not null and coalesce(amount, debit, credit) is not null"""


QUERIES["ordered_rows"] = lambda spark, sf_dir: regions.ordered_rows(_ordered_words(spark, sf_dir), _ordered_columns(spark, sf_dir)).select(
    "doc_id", "transaction_date", "value_date", "description", "amount", "debit", "credit", "balance", "transaction_id"
)
ORACLE_SQL["ordered_rows"] = _ordered_sql()

# headers of statements: "Value" over "Date" at a distance that differs by customer, headers in pieces, and none
_DX, _GAP = "(c_custkey % 31 - 15)", "(c_custkey % 23)"
STACKED = [
    ("'Date'", "20", "60", "100"), ("'Value'", "80", "120", "100"), ("'Date'", f"80 + {_DX}", f"116 + {_DX}", f"100 + {_GAP}"), ("'Description'", "200", "260", "100"), ("'Amount'", "300", "340", "100"),
]
PIECES = [("'Date'", "20", "60", "100"), ("'Particulars'", "140", "200", "116"), ("'Withdrawals'", "300", "360", "132"), ("'Balance'", "500", "540", "148")]
COVER = [("'Statement'", "20", "70", "10"), ("'Date'", "80", "110", "10"), ("'Opening'", "20", "60", "30"), ("'Balance'", "70", "110", "30")]


def _placed(rows: DataFrame, tokens: list[tuple[str, str, str, str]], page: int) -> DataFrame:
    """Words of each customer's page: tokens of (text, left end, right end, top)."""
    number = lambda x: F.expr(f"cast({x} as double)")
    each = F.array(*[F.struct(F.expr(t).alias("text"), number(a).alias("x0"), number(b).alias("x1"), number(y).alias("top"), (number(y) + 8).alias("bottom")) for t, a, b, y in tokens])
    return rows.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(page).alias("page_number"), F.explode(each).alias("w")).select("doc_id", "page_number", "w.*")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey")


def _lines(spark: SparkSession, sf_dir: str, test: str) -> DataFrame:
    """Orders below the header of the second page, two dates each."""
    day = lambda n: f"date_format(date_add(cast(o_orderdate as date), {n}), 'dd/MM/yyyy')"
    tokens = [(day(0), "20", "60"), (day(2), "80", "116"), ("'ORDER'", "200", "240"), ("concat('K', o_orderkey)", "242", "290"), ("format_number(cast(o_totalprice as decimal(18,2)), 2)", "305", "345")]
    return _words(_orders(spark, sf_dir).filter(test), tokens, page="2", top="160 + line * 12.0")


def _stacked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_customers(spark, sf_dir), STACKED, 1)


def _pieces_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_customers(spark, sf_dir), PIECES, 2).unionByName(_lines(spark, sf_dir, "true"))


def _mixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's statement: a cover, then a page with stacked headers, with headers in pieces, or with orders alone."""
    people = _customers(spark, sf_dir)
    parts = [_placed(people, COVER, 1), _placed(people.filter("c_custkey % 4 < 2"), STACKED, 2), _placed(people.filter("c_custkey % 4 = 2"), PIECES, 2), _lines(spark, sf_dir, "true")]
    words = parts[0]
    for p in parts[1:]:
        words = words.unionByName(p)
    return words


_COLUMNS = ["doc_id", "page_number", "header", "role", "x0", "x1", "top", "confidence"]
# what the geometry of the one pair of words says
_PAIR = f"""select cast(c_custkey as varchar) as doc_id, c_custkey, {_DX} as dx, {_GAP} as gap, greatest(0, least(120, 116 + {_DX}) - greatest(80, 80 + {_DX})) / 36.0::double as overlap,
  abs(2 - {_DX}) / 40.0::double as off from customer"""
_JOINED = f"""select *, gap between 1 and 14 and overlap >= 0.55 and off <= 0.8 and overlap * 0.6 + (1 - off) * 0.25 + greatest(0, 1 - gap / 18.0::double) * 0.15 >= 0.7 as joined from ({_PAIR})"""


def _stacked_sql(test: str = "true", page: int = 1) -> str:
    """Columns of the stacked layout, each with the customers that have it."""
    column = lambda header, role, x0, x1, top, when: f"select doc_id, c_custkey, {page} as page_number, '{header}' as header, '{role}' as role, cast({x0} as double) as x0, cast({x1} as double) as x1, cast({top} as double) as top, 0.99::double as confidence from j where {test} and {when}"
    parts = [
        column("Date", "transaction_date", 20, 60, 100, "true"), column("Value Date", "value_date", "least(80, 80 + dx)", "greatest(120, 116 + dx)", 100, "joined"), column("Value", "amount", 80, 120, 100, "not joined"),
        column("Date", "transaction_date", "80 + dx", "116 + dx", "100 + gap", "not joined and gap <= 14"), column("Description", "description", 200, 260, 100, "true"), column("Amount", "amount", 300, 340, 100, "true"),
    ]
    return " union all ".join(parts)


_PIECES_COLUMNS = "[{'h': 'Date', 'r': 'transaction_date', 'a': 20, 'b': 60, 't': 100}, {'h': 'Particulars', 'r': 'description', 'a': 140, 'b': 200, 't': 116}, {'h': 'Withdrawals', 'r': 'debit', 'a': 300, 'b': 360, 't': 132}, {'h': 'Balance', 'r': 'balance', 'a': 500, 'b': 540, 't': 148}]"
_PIECES_SQL = f"""select cast(c_custkey as varchar) as doc_id, c_custkey, 2 as page_number, c.h as header, c.r as role, cast(c.a as double) as x0, cast(c.b as double) as x1, cast(c.t as double) as top, 0.99::double as confidence,
  round(0.9 * (0.8 + 0.2 * 0.99) * 0.65 + least(n / 10.0::double, 1) * 0.35, 4) as score, n as transaction_rows from (select o_custkey as c_custkey, count(*) as n from orders group by 1), (select unnest({_PIECES_COLUMNS}) as c) where n >= 2"""

QUERIES["stacked_headers"] = lambda spark, sf_dir: structure.stacked_headers(structure.header_bands(_stacked_words(spark, sf_dir))).select("doc_id", "page_number", F.inline("headers")).select(*_COLUMNS)
ORACLE_SQL["stacked_headers"] = f"with j as ({_JOINED}) select {', '.join(_COLUMNS)} from ({_stacked_sql()})"

QUERIES["fragmented_tables"] = lambda spark, sf_dir: structure.fragmented_pages(_pieces_words(spark, sf_dir)).select(
    "doc_id", "page_number", F.round("score", 4).alias("score"), F.col("transaction_rows").cast("long").alias("transaction_rows"), F.inline("columns")
)
ORACLE_SQL["fragmented_tables"] = f"select {', '.join(_COLUMNS)}, score, transaction_rows from ({_PIECES_SQL})"

QUERIES["structure_pages"] = lambda spark, sf_dir: structure.structure_pages(_mixed_words(spark, sf_dir)).select("doc_id", "page_number", "score", "fragmented", F.inline("columns"))
ORACLE_SQL["structure_pages"] = f"""with j as ({_JOINED}),
  s as (select {', '.join(_COLUMNS)}, round((0.75 + case when bool_or(role = 'value_date') over (partition by doc_id) then 0.1 else 0 end) * 0.998, 4) as score, false as fragmented from ({_stacked_sql('c_custkey % 4 < 2', 2)}))
  select * from s union all select {', '.join(_COLUMNS)}, score, true from ({_PIECES_SQL}) where c_custkey % 4 = 2"""

QUERIES["statement_rows"] = lambda spark, sf_dir: structure.statement_rows(_mixed_words(spark, sf_dir)).select(
    "doc_id", "transaction_date", "value_date", "description", "amount", "debit", "balance"
)
_DAY = "strftime(cast(o_orderdate as date) + {}, '%d/%m/%Y')".format
# a "Value" that is not joined with the "Date" below it is a value date all the same where they are near; with a third date
# column two dates fill all three only if the value date is the second one
ORACLE_SQL["statement_rows"] = f"""with j as (select *, not joined and gap between 1 and 20 and abs(dx - 2) <= 12 as near from ({_JOINED})), n as (select o_custkey, count(*) as n from orders group by 1)
  select doc_id, case when c_custkey % 4 < 2 and not joined and not near and gap <= 14 then {_DAY(2)} else {_DAY(0)} end as transaction_date, case when c_custkey % 4 < 2 and (joined or near) then {_DAY(2)} end as value_date,
    'ORDER K' || o_orderkey as description, case when c_custkey % 4 < 2 then cast(cast(o_totalprice as decimal(18,2)) as double) end as amount,
    case when c_custkey % 4 = 2 then cast(cast(o_totalprice as decimal(18,2)) as double) end as debit, cast(null as double) as balance
  from orders join j on o_custkey = c_custkey join n using (o_custkey) where (c_custkey % 4 < 2 and not (near and gap <= 14 and dx < 2)) or (c_custkey % 4 = 2 and n >= 2)"""

# scanned pages: two passes of numbers, dates with marks around them, whole numbers beside decimal ones
def _scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words and numbers of one page for each customer: a header, and a region for each order."""
    rows = _orders(spark, sf_dir).withColumn("y", F.expr("150 + line * 60.0D"))
    amount, balance = "format_number(cast(o_totalprice as decimal(18,2)), 2)", "format_number(cast(o_totalprice * 3 as decimal(18,2)), 2)"
    at, right = "(if(o_orderstatus = 'P', 400, 300) + o_orderkey * 37 % 61 - 30)", "(500 + o_orderkey * 29 % 41 - 20)"
    day = "date_format(o_orderdate, 'dd/MM/yyyy')"
    first = [(f"if(o_orderkey % 4 = 0, concat('|', {day}, ','), {day})", "20", "0", "1"), ("'ORDER'", "120", "-5", "0"), ("concat('K', o_orderkey)", "165", "8", "2"), (amount, at, "1", "1")]
    first += [(f"if(o_orderkey % 3 <> 0, {balance}, null)", right, "1", "1"), ("if(o_orderkey % 7 = 0, '75', null)", f"{at} - 60", "2", "1")]
    second = [(amount, f"{at} + 3", "2", "0"), (balance, f"{right} + 3", "2", "0")]

    def words(tokens: list[tuple[str, str, str, str]]) -> DataFrame:
        each = F.array(*[F.expr(f"struct({t} as text, cast({x} as double) as x0, cast({x} + 40 as double) as x1, y + {dy} as top, cast(10 + line * 3 + {n} as int) as line_)") for t, x, dy, n in tokens])
        out = rows.select(F.expr("cast(o_custkey as string)").alias("doc_id"), F.lit(1).alias("page_number"), F.explode(each).alias("w")).select("doc_id", "page_number", "w.*").filter("text is not null")
        return out.withColumnRenamed("line_", "line").withColumn("bottom", F.col("top") + 8).withColumn("block", F.lit(1)).withColumn("paragraph", F.lit(1))

    head = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 40)).alias("x1"), F.lit(150.0).alias("top"), F.lit(1).alias("line")) for t, x in (("Date", 20), ("Description", 120), ("Withdrawals", 300), ("Deposits", 400), ("Balance", 500))])
    heads = rows.select(F.expr("cast(o_custkey as string)").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("page_number"), F.explode(head).alias("w")).select("doc_id", "page_number", "w.*")
    heads = heads.withColumn("bottom", F.col("top") + 8).withColumn("block", F.lit(1)).withColumn("paragraph", F.lit(1))
    return words(first).unionByName(heads), words(second)


QUERIES["ocr_rows"] = lambda spark, sf_dir: scanned.scanned_rows(*_scanned(spark, sf_dir)).select(
    "doc_id", "position", "transaction_date", "description", *(F.col(c).cast("double").alias(c) for c in ("debit", "credit", "balance"))
)
ORACLE_SQL["ocr_rows"] = """select cast(o_custkey as varchar) as doc_id, line as position, strftime(o_orderdate, '%d/%m/%Y') as transaction_date, 'ORDER K' || o_orderkey as description,
    case when o_orderstatus <> 'P' then v end as debit, case when o_orderstatus = 'P' then v end as credit, cast(cast(o_totalprice * 3 as decimal(18,2)) as double) as balance
  from (select *, cast(cast(o_totalprice as decimal(18,2)) as double) as v, row_number() over (partition by o_custkey order by o_orderkey) as line, count(*) over (partition by o_custkey) as n from orders) where n >= 2"""

# balances printed now and then, some of them wrong; debits and credits missing or misread
_SIGNED = "case when o_orderstatus = 'P' then cast(o_totalprice as decimal(18,2)) else -cast(o_totalprice as decimal(18,2)) end"


def _statement(d: Dialect) -> list[tuple[str, str]]:
    said = "cast(o_totalprice as decimal(18,2)) + case when o_orderkey % 11 = 0 then 7 else 0 end"
    side = lambda test: f"cast(case when {test} and o_orderkey % 3 <> 0 then {said} end as decimal(18,2))"
    running = f"1000000 + sum({_SIGNED}) over (partition by o_custkey order by o_orderkey rows unbounded preceding)"
    return [
        ("doc_id", f"cast(o_custkey as {'string' if d.spark else 'varchar'})"), ("page_number", "1"), ("position", "o_orderkey"),
        ("description", "case o_orderkey % 5 when 0 then 'SALARY' when 1 then 'ATM' else 'shop' end"),
        ("amount", "cast(case when o_orderkey % 6 = 0 then o_totalprice end as decimal(18,2))"), ("debit", side("o_orderstatus <> 'P'")), ("credit", side("o_orderstatus = 'P'")),
        ("balance", f"cast(case when o_orderkey % 4 < 2 then {running} + case when o_orderkey % 13 = 0 then 50 else 0 end end as decimal(18,2))"),
    ]


QUERIES["reconcile_rows"] = lambda spark, sf_dir: scanned.reconcile_rows(scanned.carry_balances(table(spark, sf_dir, "orders").selectExpr(*(f"{e} as {n}" for n, e in _statement(S))))).select(
    "doc_id", "position", *(F.col(c).cast("double").alias(c) for c in ("amount", "debit", "credit", "balance"))
)


def _reconcile_sql() -> str:
    """Both passes row after row, as recursions over the rows of all statements."""
    kind = "decimal(18,2)"
    cast = lambda e, name: f"cast({e} as {kind}) as {name}"
    move = "coalesce(-b.debit, b.credit)"
    opening = "coalesce(b.debit, 0) = 0 and coalesce(b.credit, 0) = 0 and coalesce(b.amount, 0) = 0 and b.balance is not null and b.description = 'SALARY'"
    worded = f"{move} is null and b.balance is null and b.amount is not null"
    carried = f"case when {move} is not null and (b.balance is null or abs(b.balance - p.last - {move}) > 1) then p.last + {move} else b.balance end"
    first_pass = ", ".join([
        cast(f"case when p.last is not null and {worded} and b.description in ('SALARY', 'ATM') then null else b.amount end", "amount"),
        cast(f"case when p.last is null then b.debit when {move} is null and b.balance < p.last then p.last - b.balance when {worded} and b.description = 'ATM' then b.amount else b.debit end", "debit"),
        cast(f"case when p.last is null then case when {opening} then b.balance else b.credit end when {move} is null and b.balance > p.last then b.balance - p.last when {worded} and b.description = 'SALARY' then b.amount else b.credit end", "credit"),
        cast(f"case when p.last is null then b.balance else {carried} end", "balance"), cast(f"case when p.last is null then b.balance else coalesce({carried}, p.last) end", "last"),
    ])
    both = "p.balance is not null and b.balance is not null"
    shift = "(b.balance - p.balance)"
    side = "case b.description when 'SALARY' then 'c' when 'ATM' then 'd' end"
    off_d, off_c = f"{both} and b.debit is not null and abs(-b.debit - {shift}) > 1", f"{both} and b.debit is null and b.credit is not null and abs(b.credit - {shift}) > 1"
    bare, derive = f"{both} and b.debit is null and b.credit is null", "p.balance is not null and b.balance is null"
    words = f"{derive} and b.debit is null and b.credit is null and b.amount is not null"
    new_d = f"case when {off_d} then case when {shift} < 0 then -{shift} end when ({off_c} or {bare}) and {shift} < 0 then -{shift} when {words} and {side} = 'd' then b.amount else b.debit end"
    new_c = f"case when {off_d} and {shift} > 0 then {shift} when {off_c} then case when {shift} > 0 then {shift} end when {bare} and {shift} > 0 then {shift} when {words} and {side} = 'c' then b.amount else b.credit end"
    second_pass = ", ".join([
        cast(f"case when ({both} or ({words})) and coalesce({new_d}, {new_c}) is not null then null else b.amount end", "amount"), cast(new_d, "debit"), cast(new_c, "credit"),
        cast(f"case when {derive} then p.balance + coalesce(-({new_d}), {new_c}) else b.balance end", "balance"),
    ])
    start = f"cast(null as {kind})"
    return f"""
    with recursive rows as (select {', '.join(f'{e} as {n}' for n, e in _statement(D))} from orders),
      b as (select *, row_number() over (partition by doc_id order by position) as n from rows),
      c as (select b.n, b.doc_id, b.position, b.description, {first_pass} from b, (select {start} as last) p where b.n = 1
        union all select b.n, b.doc_id, b.position, b.description, {first_pass} from c p join b on b.doc_id = p.doc_id and b.n = p.n + 1),
      r as (select b.n, b.doc_id, b.position, {second_pass} from c b, (select {start} as balance) p where b.n = 1
        union all select b.n, b.doc_id, b.position, {second_pass} from r p join c b on b.doc_id = p.doc_id and b.n = p.n + 1)
    select r.doc_id, r.position, cast(r.amount as double) as amount, cast(r.debit as double) as debit,
      cast(case when r.n = 1 and r.debit is null and r.credit is null and r.balance is not null and b.description = 'SALARY' then r.balance else r.credit end as double) as credit, cast(r.balance as double) as balance
    from r join b using (doc_id, position)"""


ORACLE_SQL["reconcile_rows"] = _reconcile_sql()

# generic_rows: dates whole, in three words or without a year (the page's year stands on it twice), one column of amounts
def _generic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _printed(S)
    at = lambda centre: (f"{centre} - 20", f"{centre} + 20")
    part = lambda pattern, test: f"if({test}, date_format(o_orderdate, '{pattern}'), null)"
    tokens = [
        (part("dd/MM/yyyy", "o_orderkey % 3 = 0"), "20", "60"), (part("dd", "o_orderkey % 3 > 0"), "20", "30"), (part("MMM", "o_orderkey % 3 > 0"), "32", "45"), (part("yy", "o_orderkey % 3 = 1"), "47", "57"),
        ("'ORDER'", "140", "180"), (t["reference"], "185", "215"), (t["stray"], *at("262")), (t["amount"], *at("(320 + (o_orderkey * 37) % 121 - 60)")), (t["balance"], *at(f"({BALANCE_CENTRE})")),
    ]
    years = [("cast(1990 + c_custkey % 10 as string)", "400", "430", "2"), ("'2024'", "300", "330", "2"), ("cast(1990 + c_custkey % 10 as string)", "400", "430", "4")]
    return _words(_orders(spark, sf_dir), tokens, top="line * 12.0 + 20 + o_orderkey % 3").unionByName(_placed(_customers(spark, sf_dir), years, 1))


def _generic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [("transaction_date", 20.0, 60.0), ("description", 140.0, 180.0), ("amount", 300.0, 340.0), ("balance", 500.0, 540.0)]
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.lit(6.0).alias("top")) for r, a, b in columns])
    return _customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("doc_id"), F.explode(each).alias("c")).select("doc_id", "c.*")


QUERIES["generic_rows"] = lambda spark, sf_dir: generic_rows.generic_rows(_generic_words(spark, sf_dir), _generic_columns(spark, sf_dir)).select(
    "doc_id", "transaction_date", "description", "amount", "balance"
)


def _generic_sql() -> str:
    t = _printed(D)
    number = lambda text, centre: f"case when {text} is not null then {{'c': cast({centre} as double), 't': {text}}} end"
    rate = lambda low, high: f"abs(n.c - {(low + high) / 2}) - case when n.c between {low - 5} and {high + 5} then 1000 else 0 end"
    first = lambda nums, low, high: f"list_sort([{{'d': {rate(low, high)}, 'c': n.c, 't': n.t}} for n in {nums}])[1]"
    return f"""
    with lines as (select cast(o_custkey as varchar) as doc_id, o_custkey, o_orderkey, o_orderdate, 'ORDER ' || {t['reference']} as description,
        [x for x in [{number(t['stray'], '262')}, {number(t['amount'], '320 + (o_orderkey * 37) % 121 - 60')}, {number(t['balance'], BALANCE_CENTRE)}] if x is not null] as nums from orders),
      a as (select *, {first('nums', 300, 340)} as amount from lines), b as (select *, [n for n in nums if not (n.c = amount.c and n.t = amount.t)] as others from a)
    select doc_id, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%Y-%m-%d') else (1990 + o_custkey % 10) || strftime(o_orderdate, '-%m-%d') end as transaction_date,
      description, amount.t as amount, {first('others', 500, 540)}.t as balance from b"""


ORACLE_SQL["generic_rows"] = _generic_sql()

# doc_metadata: the documents, and a statement of one to eight pages for each customer, each page with two of these lines
STATEMENT_LINES = [
    "Credit Card Statement", "Statement period: 01/02/2024 to 29/02/2024", "AED 5.00", "Amounts in rupees ₹ 1,00.00", "OPENING BALANCE: 1,234.50", "Transaction Date Description Amount",
    "Savings Account statement of account", "Card Limit  Available Limit\n10,000.00 5,000.00 250.00 15/03/2024\n300.00 12.00 4,500.00", "Period 2023-01-01 to 2023-01-31", "Withdrawals Deposits Balance",
    "USD and $ 7.25", "Post Date Trans Date Particulars", "reference no 7 on 01-02-2024", "Card Limit 5.00 6.00 7.00 1/1/24 8.00", "nothing to see", "Type of account: current", "EUR 12.00 EUR", "Transactions of the month",
]


def _metadata_pages(d: Dialect) -> str:
    """(page_number, text) of a customer's pages."""
    line = lambda key: d.item(d.array(map(d.text, [x.replace(chr(10), "@") for x in STATEMENT_LINES])), f"({key}) % {len(STATEMENT_LINES)} + 1")
    text = f"replace(concat({line('c_custkey * 7 + n * 5')}, '@', {line('c_custkey + n * n')}), '@', {'chr(10)'})"
    return f"select cast(c_custkey as {'string' if d.spark else 'varchar'}) as doc_id, cast(n as {'int' if d.spark else 'integer'}) as page_number, {text} as text from"


def _statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 8 + 1).cast("int"))).alias("n"))
    pages = people.selectExpr(*_metadata_pages(S).removeprefix("select ").removesuffix(" from").replace(" as doc_id, ", " as doc_id@@").replace(" as page_number, ", " as page_number@@").split("@@"))
    documents = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(1).alias("page_number"), "text")
    return pages.unionByName(documents)


def _metadata_sql() -> str:
    """The same fields over the first six pages and over all, and a choice between them."""
    nested = "pages"
    for step in metadata.steps(D):
        nested = f"(select *, {', '.join(f'{e} as {n}' for n, e in step.items())} from {nested})"
    joined = lambda test: f"select doc_id, count(*) as read_pages, any_value(page_count) as page_count, string_agg(coalesce(text, ''), chr(10) order by page_number) as text from numbered where {test} group by doc_id"
    fields = ", ".join(f"cast({f} as double) as {f}" if f == "confidence" else f for f in metadata.FIELDS)
    return f"""with raw as ({_metadata_pages(D)} (select c_custkey, unnest(range(1, c_custkey % 8 + 2)) as n from customer) union all select 'd' || doc_id, 1, text from documents),
      numbered as (select *, count(*) over (partition by doc_id) as page_count, row_number() over (partition by doc_id order by page_number) as r from raw),
      pages as ({joined(f'r <= {metadata.FIRST_PAGES}')} union all {joined(f'page_count > {metadata.FIRST_PAGES}')}),
      told as (select *, bool_or(read_pages < page_count and not ({metadata.OPEN})) over (partition by doc_id) as soon from {nested})
    select doc_id, {fields} from told where (soon and read_pages < page_count) or (not soon and read_pages = page_count)"""


QUERIES["doc_metadata"] = lambda spark, sf_dir: metadata.document_metadata(_statement_texts(spark, sf_dir))
ORACLE_SQL["doc_metadata"] = _metadata_sql()

# header_groups: every customer's header line, its words close to each other or not
_HEADER_TEXTS = [" ".join(h.replace("|", " ").split()) for h in HEADERS] + ["Effective Available Balance Payment Due Date", "Value date Value Post Date Closing balance"]


def _header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, _HEADER_TEXTS))
    rows = _customers(spark, sf_dir).withColumn("ws", F.split(texts[(F.col("c_custkey") % len(_HEADER_TEXTS)).cast("int")], " "))
    gap = F.when(F.col("c_custkey") % 3 == 0, 26.0).otherwise(20.0)
    words = rows.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), gap.alias("gap"), F.posexplode("ws").alias("i", "text"))
    left = 10.0 + F.col("i") * (30.0 + F.col("gap"))
    return words.select("doc_id", "page_number", "text", left.alias("x0"), (left + 30.0).alias("x1"), (50.0 + F.col("i") % 2).alias("top"), F.lit(60.0).alias("bottom"))


QUERIES["header_groups"] = lambda spark, sf_dir: structure.header_groups(_header_words(spark, sf_dir)).select("doc_id", "header", "x0", F.col("words").cast("long").alias("words"))


def _header_groups_sql() -> str:
    """Phrases are put in brackets, the leftmost and longest first; where words stand apart none is."""
    longest = "|".join(sorted((p.replace(".", "\\.") for p in structure.PHRASES), key=lambda p: -p.count(" ")))
    texts = D.array(map(D.text, _HEADER_TEXTS))
    marked = f"regexp_replace(ws || ' ', '(?i)\\b({longest}) ', '<\\1>', 'g')"
    return f"""with w as (select cast(c_custkey as varchar) as doc_id, c_custkey, list_extract({texts}, c_custkey % {len(_HEADER_TEXTS)} + 1) as ws from customer),
      m as (select doc_id, c_custkey, case when c_custkey % 3 = 0 then ws || ' ' else {marked} end as marked from w),
      g as (select doc_id, c_custkey, [replace(replace(p, '<', ''), '>', '') for p in regexp_extract_all(marked, '<[^>]*>|[^ <>]+')] as groups from m),
      e as (select doc_id, c_custkey, unnest(groups) as header, generate_subscripts(groups, 1) as i, groups from g)
    select doc_id, header, 10.0::double + (30 + case when c_custkey % 3 = 0 then 26 else 20 end) * coalesce(list_sum([len(string_split(x, ' ')) for x in groups[1:i - 1]]), 0) as x0, len(string_split(header, ' ')) as words from e"""


ORACLE_SQL["header_groups"] = _header_groups_sql()


def printed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word, and every two words in a row, of the customers' header lines and names, and of the parts' names."""
    lines = _customers(spark, sf_dir).select(F.array(*map(F.lit, _HEADER_TEXTS))[(F.col("c_custkey") % len(_HEADER_TEXTS)).cast("int")].alias("line"))
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("line")).unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("line")))
    words = lines.unionByName(names).distinct().select(F.split("line", " ").alias("ws"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.array_join(F.slice("ws", i + 1, 2), " "))
    return words.select(F.explode(F.concat("ws", pairs)).alias("header"))
