"""Statement-level facts read from page lines, the card test, the category dimension, answers in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import values
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.functions.vocabulary import TAXONOMY
from ledgerflow.operators import metrics

_AMOUNT = r"\(?-?[0-9][0-9,]*\.[0-9]{2}\)?(?: ?(?:CR|DR))?"

#: Labels of a card summary and the field each names (fixed values).
CARD_LABELS = {
    "card_limit": "card limit|credit limit",
    "available_limit": "available limit|available credit",
    "minimum_payment_due": "minimum payment due|minimum amount due|minimum payment",
    "total_payment_due": "total payment due|total amount due",
    "current_balance": "current balance|statement balance",
}
CARD_TERMS = ["credit card", "card limit", "minimum payment", "cashback", "retail purchase", "card payment"]
BANK_TERMS = ["savings account", "current account", "withdrawal", "deposit", "cheque", "neft", "imps", "rtgs"]


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, line_number, line) in reading order of the pages (doc_id, page_number, text)."""
    each = pages.select("doc_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    return each.select("doc_id", (F.col("page_number").cast("long") * 100_000 + F.col("n")).alias("line_number"), F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"))


def bank_balances(pages: DataFrame) -> DataFrame:
    """Opening and closing balance of each document (DOC6): the first amount of an opening line, the last of a closing line,
    else the last amount marked Cr or Dr above a grand total."""
    rows = lines(pages).withColumn("_a", F.regexp_extract("line", f"(?i)({_AMOUNT})$", 1)).withColumn("value", F.expr(values.signed_decimal(S, "_a")))
    low = F.lower("line")
    opening = low.rlike("opening balance|balance b/f|brought forward") & F.col("value").isNotNull()
    closing = low.rlike("closing balance|balance c/f|carried forward") & F.col("value").isNotNull()
    total_at = F.min(F.when(low.rlike("grand total"), F.col("line_number"))).over(Window.partitionBy("doc_id"))
    marked = F.col("_a").rlike("(?i)(cr|dr)$") & (F.col("line_number") < F.coalesce(total_at, F.lit(2**62)))
    rows = rows.withColumn("marked", marked)
    return rows.groupBy("doc_id").agg(
        F.min_by("value", F.when(opening, F.col("line_number"))).alias("opening_balance"),
        F.coalesce(F.max_by("value", F.when(closing, F.col("line_number"))), F.max_by("value", F.when(F.col("marked"), F.col("line_number")))).alias("closing_balance"),
    )


def card_summary(pages: DataFrame) -> DataFrame:
    """Limits and dues of card statements (DOC7, HLP26): the first amount after a label on its line, else on the next line.

    Only documents with two labels or more are card statements."""
    rows = lines(pages).withColumn("after", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_number")))
    found = []
    for field, labels in CARD_LABELS.items():
        own = F.regexp_extract("line", rf"(?i)(?:{labels})[^0-9(]*({_AMOUNT})", 1)
        following = F.when(F.col("line").rlike(rf"(?i)^({labels})\W*$"), F.regexp_extract("after", f"(?i)^[^0-9(]*({_AMOUNT})$", 1))
        text = F.coalesce(F.nullif(own, F.lit("")), F.nullif(following, F.lit("")))
        found.append(F.struct(F.lit(field).alias("field"), text.alias("_a")))
    each = rows.select("doc_id", "line_number", F.explode(F.array(*found)).alias("f")).select("doc_id", "line_number", "f.*").filter("_a is not null")
    each = each.withColumn("value", F.expr(values.signed_decimal(S, "_a")))
    out = each.groupBy("doc_id").pivot("field", list(CARD_LABELS)).agg(F.min_by("value", "line_number"))
    known = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in CARD_LABELS), F.lit(0))
    return out.filter(known >= 2)


def card_flags(ledger: DataFrame) -> DataFrame:
    """(statement_id, is_card): a row says so, else two card terms or more and more of them than bank terms (CL11)."""
    low = F.lower("description_raw")
    count = lambda terms: sum((F.max(F.when(F.contains(low, F.lit(t)), 1).otherwise(0)) for t in terms), F.lit(0))
    out = ledger.groupBy("statement_id").agg(F.bool_or(F.expr("statement_type = 'credit_card'")).alias("said"), count(CARD_TERMS).alias("card"), count(BANK_TERMS).alias("bank"))
    return out.select("statement_id", (F.col("said") | ((F.col("card") >= 2) & (F.col("card") > F.col("bank")))).alias("is_card"))


def category_membership(rows: DataFrame) -> DataFrame:
    """Add whether category and subcategory are of the taxonomy, and how many subcategories there are (CL4-7)."""
    table = F.create_map(*[x for c, subs in TAXONOMY.items() for x in (F.lit(c), F.array(*[F.lit(s) for s in subs]))])
    own = F.try_element_at(table, F.col("category"))
    return rows.withColumn("known", own.isNotNull()).withColumn("fits", F.coalesce(F.array_contains(own, F.col("subcategory")), F.lit(False))).withColumn("n_sub", F.coalesce(F.size(own), F.lit(0)))


def available_categories(custom: DataFrame) -> DataFrame:
    """The taxonomy's categories and custom ones, by name (CL8-9, SRC21)."""
    base = custom.sparkSession.createDataFrame([(c,) for c in TAXONOMY], "name string")
    return base.unionByName(custom.select("name")).distinct().orderBy("name")


def apply_campaign(ledger: DataFrame, pairs: DataFrame, category: str) -> DataFrame:
    """The ledger with a category set on the rows whose ``position`` is in ``pairs``, such as confirmed ones (JN6)."""
    chosen = pairs.select("position").distinct().withColumn("_hit", F.lit(True))
    out = ledger.join(chosen, "position", "left")
    return out.withColumn("category", F.when(F.col("_hit"), F.lit(category)).otherwise(F.col("category"))).withColumn("requires_review", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("requires_review"))).drop("_hit")


def answers(ledger: DataFrame, currency: str = "AED") -> DataFrame:
    """Sentences for the questions that totals answer (QA8): intent, answer."""
    totals = metrics.retrieval_totals(ledger).withColumn("net", F.col("income") - F.col("expenses"))
    money = lambda c: F.format_number(F.col(c), 2)
    said = {
        "income": F.concat(F.lit(f"You received {currency} "), money("income"), F.lit(".")),
        "expenses": F.concat(F.lit(f"You spent {currency} "), money("expenses"), F.lit(".")),
        "net": F.concat(F.lit(f"Your net cash flow was {currency} "), money("net"), F.lit(".")),
        "review": F.concat(F.col("to_review").cast("string"), F.lit(" transactions are for review.")),
    }
    return totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("intent"), t.alias("answer")) for k, t in said.items()])).alias("a")).select("a.*")
