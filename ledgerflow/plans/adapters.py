"""A ledger made from the order tables, built alike by Spark and by the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.dialect import DUCKDB, SPARK, Dialect

#: Descriptions that between them meet every rule; an order takes one by its key.
DESCRIPTIONS = [
    "FAITH CAFETERIA LLC ABU DHABI ARE", "ADNOC IND AREA 447 SHARJAH ARE", "TAP*KEETA DUBAI ARE", "AUTONOVA FOR CAR WASH ABU DHABI ARE",
    "MAWARED AL JOOD MANDI DUBAI ARE", "TRANSFER PAYMENT RECEIVED THANK YOU", "SALARY CREDIT ACME CORP", "REFUND AMAZON 12-08", "INTEREST CREDIT",
    "ANNUAL FEE CARD 4411", "ATM WDL MAIN STREET", "HOME LOAN EMI 12/36", "GST PAYMENT Q3", "ELECTRICITY BILL DEWA", "SIP MUTUAL FUND GROWW",
    "CARD PAYMENT RECEIVED", "TRF TO SAVINGS OWN ACCOUNT", "UPI/433434/PAYTM QR", "IMPS INW FROM J DOE", "COFFEE HOUSE", "NEFT-SELECT-SPEND CBK",
    "Café Été DUBAI", "LIFE PHARMACY BR 22", "CARREFOUR HYPERMARKET", "E& DIGITAL APP DUBAI", "MC DONALDS 0042", "STAR CINEMAS MALL", "POS PARKING FEE 77",
    "NETFLIX.COM ONLINE", "WIRE TRANSFER SWIFT 8811", "  ", "GOLDEN RESTAURAT LLC",
]

AMOUNT_TEXTS = ["14,000.00CR", "1,299.50", "(500.00)", "AED 75.25 DR", "₹ 1,00,000.5", "$12", "", "n/a", "-3.10", "USD 9.999"]
DATE_TEXTS = [
    "09 AUG", "16 JUN 19", "31/02/2026", "2026-08-09", "01/09/2026", "1ST JAN 70", "29.02.2024", "5-Dec-2023", "2026/1/5", "09-08/2026", "12 FOO 2020", "", "3 march 68",
]
QUESTIONS = [
    "Where did I spend the most?", "What were my largest transactions?", "How much did I spend on Healthcare?", "Give me a summary", "Smallest purchase this month",
    "Any duplicate payments to review?", "What is my net cash flow?", "How much income did I receive in total?", "How much was spent on fuel?", "Whose statement is this?",
    "Which store is at the mall?", "hello", "netflix charges", "How much salary was received?", "top merchant", "show groceries",
]

HEADERS = [
    "Date Value Date Particulars Withdrawals Deposits Balance", "Post Date Trxn. Date\nDescription Amount", "  Txn Date | Narration\n\nDebit\nCredit  \n Running Balance", "Dear customer",
    "Transaction Date, Transaction Details, Ref No, DR. CR. Balance", "Transaction # Payee\nPaid Out Paid In", "Date", "Update Value Dates and Predate Amounts", "Booking Date\nDetails\nValue\nMemo\nBalance",
]


def texts(d: Dialect, values: list[str], key: str) -> str:
    return d.item(d.array(d.text(v) for v in values), f"{key} % {len(values)} + 1")


def columns(d: Dialect) -> list[tuple[str, str]]:
    """Columns of the ledger over ``orders`` joined with ``customer``."""
    string = "string" if d.spark else "varchar"
    kinds = ["purchase", "transfer", "payment", "refund", "fee"]
    return [
        ("statement_id", f"cast(o_custkey as {string})"),
        ("position", "o_orderkey"),
        ("transaction_date", "case when o_orderkey % 41 = 0 then null else cast(o_orderdate as date) end"),
        ("posting_date", d.days_after("cast(o_orderdate as date)", "o_orderkey % 5 - 1")),
        ("description_raw", texts(d, DESCRIPTIONS, "o_orderkey")),
        ("merchant", "case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then '' else concat('Shop ', substr(c_name, -2)) end" if d.spark else
         "case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then '' else concat('Shop ', right(c_name, 2)) end"),
        ("original_amount", "case when o_orderkey % 53 = 0 then null when o_orderkey % 59 = 0 then cast(0 as decimal(18,2)) else cast(o_totalprice as decimal(18,2)) end"),
        ("statement_amount", "cast(case when o_orderkey % 17 = 0 then cast(o_totalprice as decimal(18,2)) + 1 else cast(o_totalprice as decimal(18,2)) end as decimal(18,2))"),
        ("exchange_rate", "cast(case when o_orderkey % 34 = 0 then 3.67 else null end as decimal(18,8))"),
        ("original_currency", "case when o_orderkey % 43 = 0 then null when o_orderkey % 47 = 0 then 'UNKNOWN' when c_nationkey % 3 = 0 then 'AED' when c_nationkey % 3 = 1 then 'INR' else 'USD' end"),
        ("direction", "case when o_orderkey % 61 = 0 then null when o_orderstatus = 'P' then 'credit' else 'debit' end"),
        ("transaction_type", "case " + " ".join(f"when o_orderpriority like '{i + 1}%' then '{k}'" for i, k in enumerate(kinds)) + " end"),
        ("statement_type", "case when o_custkey % 2 = 0 then 'credit_card' else 'bank_account' end"),
        ("category", "case when o_orderkey % 19 = 0 then null when o_orderkey % 23 = 0 then '' when o_orderkey % 29 = 0 then 'Other' else c_mktsegment end"),
        ("extraction_confidence", "case when o_orderkey % 7 = 0 then cast(null as double) else cast(50 + o_orderkey % 10 * 5 as double) / 100 end"),
        ("merchant_confidence", "case when o_orderkey % 3 = 0 then cast(null as double) else cast(80 + o_orderkey % 4 * 5 as double) / 100 end"),
        ("requires_review", "o_orderkey % 7 = 0"),
        ("amount_text", texts(d, AMOUNT_TEXTS, "o_orderkey")),
        ("date_text", texts(d, DATE_TEXTS, "o_orderkey")),
        ("question", texts(d, QUESTIONS, "o_orderkey")),
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger; only the columns a query uses reach the scans."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*(f"{e} as {n}" for n, e in columns(SPARK)))


LEDGER_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in columns(DUCKDB)) + " from orders join customer on o_custkey = c_custkey"


def with_balance(rows: DataFrame) -> DataFrame:
    """Add a printed running balance, wrong in some rows."""
    from pyspark.sql import Window

    signed = F.expr("coalesce(case when direction = 'credit' then original_amount else -original_amount end, 0)")
    running = F.sum(signed).over(Window.partitionBy("statement_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running_balance", (running + F.expr("case when position % 31 = 0 then 5 else 0 end")).cast("decimal(18,2)"))


BALANCE_SQL = (
    "select *, cast(sum(coalesce(case when direction = 'credit' then original_amount else -original_amount end, 0)) over (partition by statement_id order by position"
    " rows unbounded preceding) + case when position % 31 = 0 then 5 else 0 end as decimal(18,2)) as running_balance from ledger"
)


def with_copies(rows: DataFrame) -> DataFrame:
    """Enter some rows a second time, further down."""
    return rows.unionByName(rows.filter("position % 97 = 0").withColumn("position", F.col("position") + 10_000_000))


COPIES_SQL = "select * from ledger union all select * replace (position + 10000000 as position) from ledger where position % 97 = 0"


def headed_pages(d: Dialect) -> list[str]:
    """A document of two pages for each customer; most have a table's header."""
    page = lambda key, first: f"concat({d.text(first)}, c_name, chr(10), {texts(d, HEADERS, key)}, chr(10), '01/02/2024 PAYMENT 12.00', chr(10), c_mktsegment)"
    pages = d.array([page("c_custkey", "STATEMENT OF ACCOUNT\n \n"), page("(c_custkey + c_nationkey)", "")])
    return [f"cast(c_custkey as {'string' if d.spark else 'varchar'}) as doc_id", f"{pages} as pages"]
