"""Questions answered in sentences from the totals of a ledger (QA7-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import text
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.operators import metrics, retrieval

#: Answers where the ledger has nothing to say on an intent (fixed values).
NOTHING = {
    "top_merchant": "I couldn't identify an outgoing merchant from the analyzed transactions.",
    "category_spend": "There isn't enough category information in this statement to summarize spending areas.",
    "largest_transaction": "I couldn't find outgoing transactions to rank.",
    "smallest_transaction": "I couldn't find outgoing transactions to rank.",
    "identity": "The extracted transaction data does not contain enough account-holder information to identify whose statement this is.",
}


def common_currency(ledger: DataFrame) -> DataFrame:
    """One row: the currency of most rows, in capitals, of the earliest row on ties; null without one (AG15)."""
    rows = ledger.select(F.upper("original_currency").alias("c"), "position").filter("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("p"))
    return rows.agg(F.max(F.struct("n", -F.col("p"), "c"))["c"].alias("currency"))


def _listed(rows: DataFrame, line: Column, *order: Column | str) -> DataFrame:
    """One row: the lines of a few rows, in order; null without rows."""
    parts = rows.select(F.struct(*order, line.alias("line")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"])
    return parts.agg(F.when(F.count("r") > 0, F.array_join(lines, "\n")).alias("lines"))


def evidence(ledger: DataFrame, shown: int = 5) -> DataFrame:
    """Sentences by intent and what they are about (a category or merchant in small letters, else ''): intent, about, answer.

    ``ledger`` may have ``notes`` and ``account_holder``.  Every row comes from an aggregate; lists hold ``shown`` rows.
    """
    code = F.coalesce(common_currency(ledger).scalar(), F.lit("UNKNOWN"))
    money = lambda c: F.concat(code, F.lit(" "), F.format_number(c, 2))
    count = lambda c: F.col(c).cast("string")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = lambda frame, intent, about, answer: frame.select(F.lit(intent).alias("intent"), about.alias("about"), answer.alias("answer")).filter("answer is not null")
    none = F.lit("")

    shops = retrieval.merchants(ledger)
    top = shops.orderBy(F.desc("spent"), "name").limit(1)
    share = top.select(join("**", F.col("name"), " — ", money("spent"), "**")).scalar()
    noted = F.lower("notes").contains("duplicate") if "notes" in ledger.columns else F.lit(False)
    totals = ledger.agg(
        F.count(F.lit(1)).alias("n"), metrics.total(metrics.credit()).alias("income"), metrics.total(metrics.debit()).alias("expenses"), F.count_if("requires_review").alias("review"),
        F.count_if(F.col("requires_review") & noted).alias("twice"),
    ).withColumn("net", F.round(F.col("income") - F.col("expenses"), 2))
    calm = F.coalesce(join("No transactions are currently marked for review. The largest spending concentration is ", share, ". You can inspect those transactions if you want to understand the spending."), F.lit("No transactions are currently marked for review."))
    said = {
        "summary": join("This statement contains **", count("n"), " transactions**, with **", money("income"), " received** and **", money("expenses"), " spent**. Net cash flow is **", money("net"), "**.",
                        F.coalesce(join(" Your largest merchant concentration is ", share, "."), none)),
        "income": join("Total money received in this statement: **", money("income"), "**."),
        "expenses": join("Total money spent in this statement: **", money("expenses"), "**."),
        "net": join("Your net cash flow is **", money(F.abs("net")), "** (", F.when(F.col("net") >= 0, "positive").otherwise("negative"), ")."),
        "review": F.when(F.col("review") > 0, join("**", count("review"), " transaction(s)** are marked for review, including **", count("twice"), " possible duplicate(s)**.")).otherwise(calm),
    }
    whole = totals.select(F.explode(F.array(*[F.struct(F.lit(i).alias("intent"), none.alias("about"), a.alias("answer")) for i, a in said.items()])).alias("r")).select("r.*")

    best = rows(top, "top_merchant", none, join("Your highest-spending merchant is **", F.col("name"), "**, with **", money("spent"), "** across **", count("transactions"), " transaction(s)**."))

    kinds = retrieval.inferred_categories(ledger).filter(metrics.debit()).groupBy(F.coalesce("i_category", F.lit("Uncategorized")).alias("category")).agg(
        F.sum(metrics.amount()).cast("double").alias("spent"), F.count(F.lit(1)).alias("transactions"), F.bool_or(F.col("i_confidence") < 1).alias("inferred")
    )
    areas = _listed(kinds.orderBy(F.desc("spent"), "category").limit(shown), join("- **", F.col("category"), "** — ", money("spent"), " (", count("transactions"), " transactions)"), -F.col("spent"), "category")
    areas = rows(areas, "category_spend", none, join("The largest inferred spending areas are:\n\n", F.col("lines")))
    named = kinds.groupBy(F.lower("category").alias("about")).agg(
        F.sum("spent").alias("spent"), F.sum("transactions").alias("transactions"), F.bool_or("inferred").alias("inferred"), F.min("category").alias("category")
    )
    source = F.when(F.col("inferred"), "This is inferred from merchant/description text.").otherwise("This category is present in the extracted statement data.")
    named = rows(named, "category_spend", F.col("about"), join("You spent **", money("spent"), "** on **", F.col("category"), "** across **", count("transactions"), " transaction(s)**. ", source))

    name = F.coalesce(F.expr("nullif(trim(merchant), '')"), F.expr("nullif(trim(description_raw), '')"), F.lit("Unknown"))
    spent = ledger.filter(metrics.debit()).select(name.alias("name"), metrics.amount().cast("double").alias("amount"), "transaction_date", "position")
    line = join("- **", F.col("name"), "** — ", money("amount"), " on ", F.coalesce(F.col("transaction_date").cast("string"), F.lit("date unavailable")))
    ranked = []
    for intent, kept, key in (("largest", spent, -F.col("amount")), ("smallest", spent.filter("amount > 0"), F.col("amount"))):
        few = _listed(kept.orderBy(key, "position").limit(shown), line, key, "position")
        ranked.append(rows(few, f"{intent}_transaction", none, join(f"Your {intent} outgoing transactions are:\n\n", F.col("lines"))))

    each = ledger.groupBy(F.lower(F.expr(text.cleaned(S, "merchant"))).alias("about")).agg(
        metrics.total(metrics.debit()).alias("spent"), F.count_if(F.coalesce(metrics.debit(), F.lit(False))).alias("transactions"), F.min_by(F.expr(text.cleaned(S, "merchant")), "position").alias("name")
    )
    each = rows(each.filter("about <> 'unknown'"), "merchant_spend", F.col("about"), join("You spent **", money("spent"), "** at **", F.col("name"), "** across **", count("transactions"), " transaction(s)**."))

    out = whole.unionByName(best).unionByName(areas).unionByName(named).unionByName(each)
    for part in ranked:
        out = out.unionByName(part)
    if "account_holder" in ledger.columns:
        holders = ledger.select(F.trim("account_holder").alias("h"), "position").filter("h <> ''").groupBy("h").agg(F.min("position").alias("p")).orderBy("p").limit(shown)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda r: r["h"]), ", ")
        holders = holders.agg(F.when(F.count("h") > 0, listed).alias("names"))
        out = out.unionByName(rows(holders, "identity", none, join("The statement data identifies the account holder as **", F.col("names"), "**.")))
    return out


def answered(ledger: DataFrame, questions: DataFrame, shown: int = 5) -> DataFrame:
    """One row per question (question_id, question): question_id, intent, about, answer.

    A question of no known intent, or about a merchant that the ledger does not have, has no answer (null); a category
    without rows is said to have none.  Questions meet the sentences by intent and subject, of which there is one each.
    """
    asked = retrieval.intents(questions.select("question_id", "question"))
    shops = retrieval.find_merchants(ledger, asked.filter("intent = 'merchant_spend'").select("question_id", "question"))
    asked = asked.join(shops, "question_id", "left")
    about = F.when(F.col("intent") == "category_spend", F.col("q_category")).when(F.col("intent") == "merchant_spend", F.expr(text.cleaned(S, "merchant")))
    asked = asked.select("question_id", "intent", F.lower(F.coalesce(about, F.lit(""))).alias("about"), "q_category")
    default = F.when((F.col("intent") == "category_spend") & (F.col("about") != ""), F.concat(F.lit("I couldn't identify any transactions that can be attributed to **"), "q_category", F.lit("** in this statement.")))
    for intent, sentence in NOTHING.items():
        default = default.when(F.col("intent") == intent, sentence)
    out = asked.join(evidence(ledger, shown), ["intent", "about"], "left")
    return out.select("question_id", "intent", "about", F.coalesce("answer", default).alias("answer"))
