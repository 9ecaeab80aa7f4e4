"""Registered ledger queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions import classify, headers, text, tokens, values
from ledgerflow.functions.dialect import DUCKDB as D
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.functions.vocabulary import BANK_SIGNALS, CARD_SIGNALS, ISSUES, TAXONOMY, UNKNOWN_CURRENCIES
from ledgerflow.operators import answers, canonical, layout, memory, metrics, report, retrieval, statement_pipeline, statements, text_structure, validate
from ledgerflow.plans import layouts
from ledgerflow.plans.adapters import BALANCE_SQL, COPIES_SQL, LEDGER_SQL, QUESTIONS, headed_pages, ledger, table, with_balance, with_copies
from ledgerflow.sources import restore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None = None, base: bool = True) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = f"with ledger as ({LEDGER_SQL}) {sql}" if base else sql


def _on_ledger(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(ledger(spark, sf_dir))


def _projected(*pairs: tuple[str, Callable]) -> tuple[Query, str]:
    """A projection of expressions that both engines build from one rule."""
    run = _on_ledger(lambda rows: rows.selectExpr("position", *(f"{make(S)} as {name}" for name, make in pairs)))
    return run, "select position, " + ", ".join(f"{make(D)} as {name}" for name, make in pairs) + " from ledger"


AMOUNT = "abs(coalesce(original_amount, 0))"
CATEGORY = "coalesce(nullif(trim(category), ''), 'Uncategorized')"
MERCHANT = "coalesce(nullif(trim(merchant), ''), nullif(trim(description_raw), ''), 'Unknown merchant')"
SPENT = "direction = 'debit' and transaction_type <> 'transfer'"
EARNED = "direction = 'credit' and transaction_type not in ('transfer', 'payment', 'refund')"
CREDIT = "coalesce(direction = 'credit', false)"


def total(test: str, value: str = AMOUNT) -> str:
    return f"cast(coalesce(sum(case when {test} then {value} end), 0) as double)"


# totals under the four definitions
_add(
    "summary_analyzer",
    _on_ledger(metrics.analyzer_summary),
    f"select *, round(income - expenses, 2) as net from (select {total(EARNED, 'original_amount')} as income, {total(SPENT, 'original_amount')} as expenses,"
    f" {total('transaction_type = ' + repr('transfer'), 'original_amount')} as transfers, {total('transaction_type = ' + repr('refund'), 'original_amount')} as refunds,"
    " count(*) as transactions from ledger)",
)
_add(
    "income_expense_dashboard",
    _on_ledger(metrics.dashboard_totals),
    "select statement_id, card, income, expenses, round(income - expenses, 2) as net from (select statement_id, card, case when card then ci else bi end as income,"
    " case when card then ce else be end as expenses from (select statement_id, bool_or(statement_type = 'credit_card') as card,"
    f" {total('transaction_type in (' + repr('refund') + ', ' + repr('cashback') + ')')} as ci, {total('transaction_type = ' + repr('purchase'))} as ce,"
    f" {total(CREDIT)} as bi, {total('not ' + CREDIT)} as be from ledger group by statement_id))",
)
_add(
    "income_expense_retrieval",
    _on_ledger(metrics.retrieval_totals),
    f"select {total(CREDIT)} as income, {total('direction = ' + repr('debit'))} as expenses, count(*) filter (requires_review) as to_review, min(transaction_date) as first_date,"
    " max(transaction_date) as last_date from ledger",
)
_add("income_expense_report", _on_ledger(metrics.report_totals), f"select *, round(income - expenses, 2) as net from (select {total(CREDIT)} as income, {total('not ' + CREDIT)} as expenses from ledger)")

# breakdowns
for key, column, alias, missing in (("spending_by_category", "category", "category", "Other"), ("spending_by_merchant", "merchant", "merchant", "Unknown")):
    named = f"coalesce(nullif({column}, ''), '{missing}')"
    sql = f"select coalesce(nullif({column}, ''), '{missing}') as {alias}, cast(sum(original_amount) as double) as spent, min(position) as first_position from ledger where {SPENT} group by 1"
    _add(key, _on_ledger(lambda rows, n=named, a=alias: metrics.spending_by(rows, F.expr(n), a)), sql)
    top = "top_categories" if column == "category" else "top_merchants"
    _add(top, _on_ledger(lambda rows, n=named, a=alias: metrics.spending_by(rows, F.expr(n), a, 10)), f"select * from ({sql}) where spent is not null order by spent desc, first_position limit 10")
_add(
    "monthly_summary",
    _on_ledger(metrics.monthly_summary),
    "select *, round(income - expenses, 2) as net from (select strftime(transaction_date, '%Y-%m') as month,"
    f" {total(EARNED, 'original_amount')} as income, {total(SPENT, 'original_amount')} as expenses from ledger where transaction_date is not null and (({SPENT}) or ({EARNED})) group by 1)",
)
_add(
    "category_kpi",
    _on_ledger(metrics.by_category),
    "select category, cast(s as double) as spent, n as transactions, round(cast(s as double) / n, 2) as average, round(100.0::double * cast(s as double) / nullif(cast(sum(s) over () as double), 0), 2) as share"
    f" from (select {CATEGORY} as category, sum({AMOUNT}) as s, count(*) as n from ledger where direction = 'debit' group by 1)",
)
_add(
    "merchant_share_of_category",
    _on_ledger(metrics.merchants_of_categories),
    "select category, name, cast(s as double) as spent, n as transactions, round(100.0::double * cast(s as double) / nullif(cast(sum(s) over (partition by category) as double), 0), 2) as share"
    f" from (select {CATEGORY} as category, {MERCHANT} as name, sum({AMOUNT}) as s, count(*) as n from ledger where direction = 'debit' group by 1, 2)",
)
_add(
    "merchant_top5_others",
    _on_ledger(metrics.top_merchants_and_others),
    "select category, case when r <= 5 then name else 'Others' end as name, cast(sum(s) as double) as spent, count(*) as merchants from (select *, row_number() over (partition by category order by s desc, name) as r"
    f" from (select {CATEGORY} as category, {MERCHANT} as name, sum({AMOUNT}) as s from ledger where direction = 'debit' group by 1, 2)) group by 1, 2",
)
_add(
    "category_monthly_last6",
    _on_ledger(metrics.monthly_by_category),
    "select category, month, spent, transactions from (select *, row_number() over (partition by category order by month desc) as r from (select"
    f" {CATEGORY} as category, cast(date_trunc('month', transaction_date) as date) as month, cast(sum({AMOUNT}) as double) as spent, count(*) as transactions"
    " from ledger where direction = 'debit' and transaction_date is not null group by 1, 2)) where r <= 6",
)
_WEEKLY = (
    "select *, round(received - spent, 2) as net from (select cast(date_trunc('week', transaction_date) as date) as week,"
    f" {total(CREDIT)} as received, {total('not ' + CREDIT)} as spent from ledger where transaction_date is not null group by 1)"
)
_add("weekly_flow", _on_ledger(metrics.weekly_flow), _WEEKLY)
_add("weekly_last8", _on_ledger(lambda rows: metrics.weekly_flow(rows, 8)), f"select * from ({_WEEKLY}) order by week desc limit 8")
_add(
    "repeated_merchants",
    _on_ledger(metrics.repeated_merchants),
    f"select {MERCHANT} as name, count(*) as transactions, cast(sum({AMOUNT}) as double) as amount from ledger group by 1 having count(*) >= 2 order by transactions desc, name limit 8",
)
_COVERED = "lower(trim(coalesce(category, ''))) not in ('', 'unknown', 'uncategorized', 'other', 'none', 'null')"
_KNOWN = "lower(category) not in ('unknown', 'uncategorized', 'other', 'none', 'null')"
_add(
    "coverage_insights",
    _on_ledger(metrics.insights),
    f"with g as (select {CATEGORY} as category, sum({AMOUNT}) as s, count(*) as n, count(*) filter ({_COVERED}) as c from ledger where direction = 'debit' group by 1)"
    f" select round(100.0::double * (select sum(c) from g)::double / (select sum(n) from g)::double, 1) as coverage, t.category as top_category, round(t.s::double, 2) as top_spent, round(t.s::double * 0.1::double, 2) as saving_of_a_tenth,"
    f" case when k.n >= 2 then l.category end as least_category, k.n as categories from (select count(*) as n from g where {_KNOWN}) k, (select * from g where {_KNOWN} order by s desc, category limit 1) t,"
    f" (select * from g where {_KNOWN} order by s, category limit 1) l",
)
ORACLE_SQL["coverage_insights"] = ORACLE_SQL["coverage_insights"].replace(") with g as (", "), g as (", 1)
_add(
    "modal_currency",
    _on_ledger(metrics.modal_currency),
    "select statement_id, coalesce(currency, 'UNKNOWN') as currency from (select statement_id, currency, row_number() over (partition by statement_id order by currency is null, n desc, currency) as r from"
    " (select statement_id, nullif(original_currency, 'UNKNOWN') as currency, count(*) as n from ledger group by 1, 2)) where r = 1",
)
_add("largest_transactions", _on_ledger(metrics.largest), f"select position, statement_id, transaction_date, cast({AMOUNT} as double) as amount from ledger order by amount desc, position limit 10")
_add(
    "largest_debits",
    _on_ledger(lambda rows: metrics.largest(rows, debits=True)),
    f"select position, statement_id, transaction_date, cast({AMOUNT} as double) as amount from ledger where direction = 'debit' order by amount desc, position limit 10",
)
_add("smallest_positive", _on_ledger(metrics.smallest), f"select position, statement_id, cast({AMOUNT} as double) as amount from ledger where direction = 'debit' and {AMOUNT} > 0 order by amount, position limit 5")
_add(
    "smallest_merchant_total",
    _on_ledger(metrics.smallest_merchant),
    "select category, name, cast(s as double) as spent from (select *, row_number() over (partition by category order by s, name) as r from"
    f" (select {CATEGORY} as category, {MERCHANT} as name, sum({AMOUNT}) as s from ledger where direction = 'debit' group by 1, 2) where s > 0) where r = 1",
)
_add("category_distribution", _on_ledger(metrics.category_distribution), f"select {CATEGORY} as category, count(*) as transactions from ledger group by 1")
_PREFERRED = ["MACHINERY", "BUILDING"]
_add(
    "featured_categories",
    _on_ledger(lambda rows: metrics.featured_categories(rows, _PREFERRED)),
    f"select category, spent from (select {CATEGORY} as category, cast(sum({AMOUNT}) as double) as spent from ledger where direction = 'debit' group by 1) where lower(category) not in ('uncategorized', 'other')"
    " order by coalesce(list_position(['MACHINERY', 'BUILDING'], category), 3), spent desc, category limit 6",
)
_add(
    "ledger_pages",
    _on_ledger(metrics.pages),
    "select statement_id, position, r as row, (r - 1) // 29 + 1 as page from (select statement_id, position, row_number() over (partition by statement_id order by transaction_date nulls last,"
    f" lower({MERCHANT}), position) as r from ledger)",
)

# projections and filters
_add(
    "transaction_table",
    _on_ledger(canonical.display_rows),
    "select position, coalesce(cast(transaction_date as varchar), '') as date, coalesce(merchant, '') as merchant, coalesce(description_raw, '') as description, coalesce(nullif(category, ''), 'Uncategorized') as category,"
    " coalesce(cast(original_amount as double), 0) as amount, coalesce(original_currency, '') as currency, coalesce(direction, '') as direction,"
    " round(100 * coalesce(extraction_confidence, 0), 1) as confidence, requires_review as review from ledger",
)
_add(
    "transactions_filter",
    _on_ledger(lambda rows: canonical.search(rows, "shop 1", "debit", "BUILDING", False).select("position", "merchant", "category")),
    "select position, merchant, category from ledger where (contains(lower(coalesce(merchant, '')), 'shop 1') or contains(lower(description_raw), 'shop 1')) and direction = 'debit' and category = 'BUILDING'"
    " and not requires_review",
)
_add(
    "transactions_pattern",
    _on_ledger(lambda rows: canonical.search(rows, "(shop|MARKET) [0-9]*7$", pattern=True).select("position", "merchant")),
    "select position, merchant from ledger where regexp_matches(coalesce(merchant, ''), '(shop|market) [0-9]*7$', 'i') or regexp_matches(coalesce(description_raw, ''), '(shop|market) [0-9]*7$', 'i')",
)
_add(
    "transactions_focus",
    _on_ledger(lambda rows: canonical.focus(canonical.focus(rows, "category", "building"), "merchant", ":- SHOP 12").select("position", "merchant", "category")),
    "select position, merchant, category from ledger where lower(category) = 'building' and lower(trim(regexp_replace(coalesce(merchant, ''), '^[^a-zA-Z0-9_]+', ''))) = 'shop 12'",
)
_add(
    "editor_search",
    _on_ledger(lambda rows: canonical.editor_search(rows.withColumn("transaction_id", F.col("position").cast("string")), " 12 ").select("position", "merchant")),
    "select position, merchant from ledger where contains(lower(coalesce(merchant, '')), '12') or contains(lower(coalesce(description_raw, '')), '12') or contains(cast(position as varchar), '12')",
)
_add(
    "review_queue",
    _on_ledger(lambda rows: canonical.review_queue(rows).select("position", "category", "requires_review")),
    "select position, category, requires_review from ledger where requires_review or lower(trim(coalesce(category, ''))) in ('', 'other', 'uncategorized', 'unknown')",
)

# scalar rules
_add("date_parse", *_projected(("day_first", lambda d: values.parsed_date(d, "date_text", "2026")), ("month_first", lambda d: values.parsed_date(d, "date_text", "null", False))))
_add(
    "amount_parse",
    *_projected(
        ("amount", lambda d: f"cast({values.parsed_amount(d, 'amount_text')} as double)"),
        ("signed", lambda d: f"cast({values.signed_decimal(d, 'amount_text')} as double)"),
        ("is_credit", lambda d: values.marked_credit(d, "amount_text")),
        ("is_debit", lambda d: values.marked_debit(d, "amount_text")),
    ),
)
_add("direction_infer", *_projected(("inferred", lambda d: classify.direction(d, "description_raw"))))
_add("type_infer", *_projected(("inferred", lambda d: classify.transaction_type(d, "description_raw", "coalesce(direction, 'debit')"))))
_add("channel_infer", *_projected(("channel", lambda d: classify.channel(d, "description_raw"))))
_add(
    "merchant_key",
    *_projected(("merchant_key", lambda d: text.merchant_key(d, "merchant", "cast(null as varchar(9))", "description_raw")), ("plain", lambda d: text.normalised(d, "description_raw"))),
)
_add("merchant_family", *_projected(("family", lambda d: text.family(d, text.family_key(d, "description_raw"))), ("spend_name", lambda d: text.spend_name(d, "description_raw"))))
_add("token_index", *_projected(("words", lambda d: d.joined(text.tokens(d, "concat(description_raw, ' ', question)"), ",")), ("shown", lambda d: text.cleaned(d, "merchant"))))
_STEPS = text.merchant_columns(D, "description_raw")
_nested = "select position, description_raw from ledger"
for _name, _expression in _STEPS:
    _nested = f"select *, {_expression} as {_name} from ({_nested})"
_add(
    "merchant_normalize",
    _on_ledger(lambda rows: canonical.normalised_merchants(rows.select("position", "description_raw")).select("position", "merchant_name", F.round("merchant_score", 2).alias("merchant_score"))),
    f"select position, merchant_name, round(merchant_score, 2) as merchant_score from ({_nested})",
)
_RULED = f"select *, {classify.category_rule(D, 't')} as rule from (select *, {classify.searchable(D, 'merchant', 'description_raw')} as t from ledger)"
_add(
    "rule_classify",
    _on_ledger(lambda rows: memory.classified(rows).select("position", "rule_category", "rule_subcategory", "rule_score")),
    f"select position, {classify.rule_part(D, 'rule', 1)} as rule_category, {classify.rule_part(D, 'rule', 2)} as rule_subcategory, coalesce({classify.rule_part(D, 'rule', 3)}, 0) as rule_score from ({_RULED})",
)
_LOW = "lower(concat_ws(' ', coalesce(merchant, ''), coalesce(description_raw, ''), coalesce(transaction_type, '')))"
_CAT, _HITS = classify.keyword_category(D, "low")
_INFERRED = (
    f"select *, case when not ({text.uncategorised(D, 'category')}) then {text.cleaned(D, 'category')} else {_CAT} end as i_category, case when not ({text.uncategorised(D, 'category')}) then 1.0::double"
    f" when {_HITS} > 0 then least((55 + 12 * {_HITS})::double / 100, 0.9::double) else 0.0::double end as i_confidence from (select *, {_LOW} as low from ledger)"
)
_add(
    "category_infer_keywords",
    _on_ledger(lambda rows: retrieval.inferred_categories(rows).select("position", "i_category", F.round("i_confidence", 2).alias("i_confidence"))),
    f"select position, i_category, round(i_confidence, 2) as i_confidence from ({_INFERRED})",
)
_add(
    "inferred_category_totals",
    _on_ledger(retrieval.categories),
    f"select i_category as category, cast(sum({AMOUNT}) as double) as spent, count(*) as transactions, round(avg(cast(cast(i_confidence as decimal(6,4)) as double)), 2) as confidence from ({_INFERRED})"
    " where direction = 'debit' and i_category is not null group by 1",
)
_add(
    "retrieval_merchants",
    _on_ledger(retrieval.merchants),
    f"select {text.cleaned(D, 'coalesce(nullif(trim(merchant), ' + repr('') + '), description_raw)')} as name, cast(sum({AMOUNT}) as double) as spent, count(*) as transactions from ledger where direction = 'debit' group by 1",
)
_add(
    "intent_detect",
    _on_ledger(lambda rows: retrieval.intents(rows.select("position", "question")).select("position", "q_category", "intent")),
    f"select position, q_category, {classify.intent(D, 'q', 'q_category')} as intent from (select *, {classify.question_category(D, 'q')} as q_category from (select position, lower(trim(question)) as q from ledger))",
)

# validation
_KEY = "concat_ws('|', coalesce(cast(transaction_date as varchar), ''), coalesce(cast(original_amount as varchar), ''), coalesce(direction, ''), upper(trim(coalesce(nullif(merchant, ''), description_raw, ''))))"
_add(
    "duplicates",
    lambda spark, sf_dir: validate.duplicates(with_copies(ledger(spark, sf_dir))).select("statement_id", "position", "duplicate"),
    f"select statement_id, position, row_number() over (partition by statement_id, {_KEY} order by position) > 1 as duplicate from ({COPIES_SQL})",
)
_SIGNED = "case when direction = 'debit' then -abs(original_amount) when direction = 'credit' then abs(original_amount) end"
_MISMATCH = f"coalesce(abs(running_balance - (lag(running_balance) over (partition by statement_id order by position) + {_SIGNED})) > 0.01, false)"
_add(
    "balance_check",
    lambda spark, sf_dir: validate.balance_mismatch(with_balance(ledger(spark, sf_dir))).select("statement_id", "position", "mismatch"),
    f"select statement_id, position, {_MISMATCH} as mismatch from ({BALANCE_SQL})",
)
_CHECKED = f"select *, {_MISMATCH} as mismatch, row_number() over (partition by statement_id, {_KEY} order by position) > 1 as duplicate from ({BALANCE_SQL})"
_TESTS = {
    "MISSING_TRANSACTION_DATE": "transaction_date is null",
    "POSTING_DATE_BEFORE_TRANSACTION_DATE": "posting_date < transaction_date",
    "MISSING_AMOUNT": "original_amount is null",
    "NEGATIVE_NORMALIZED_AMOUNT": "original_amount < 0",
    "ZERO_AMOUNT": "original_amount = 0",
    "MISSING_CURRENCY": "coalesce(original_currency, '') = ''",
    "UNKNOWN_CURRENCY": f"upper(trim(original_currency)) in ({', '.join(repr(c) for c in UNKNOWN_CURRENCIES)})",
    "MISSING_DESCRIPTION": "trim(coalesce(description_raw, '')) = ''",
    "SHORT_DESCRIPTION": "length(trim(description_raw)) between 1 and 2",
    "MISSING_DIRECTION": "direction is null",
    "AMOUNT_MISMATCH": "exchange_rate is null and abs(statement_amount) <> abs(original_amount)",
    "BALANCE_MISMATCH": "mismatch",
    "POSSIBLE_DUPLICATE": "duplicate",
}
_ERRORS = " + ".join(f"case when {_TESTS[c]} then 1 else 0 end" for c, (s, _) in ISSUES.items() if s == "error")
_WARNINGS = " + ".join(f"case when {_TESTS[c]} then 1 else 0 end" for c, (s, _) in ISSUES.items() if s == "warning")
_BASE = "coalesce(extraction_confidence, 0.5::double)"
_MIXED = f"case when merchant_confidence is not null then {_BASE} * 0.8::double + merchant_confidence * 0.2::double else {_BASE} end"
_CODES = ", ".join(f"case when {t} then '{c}' end" for c, t in _TESTS.items())
_NOTES = ", ".join(f"case when {t} then '{c}: {ISSUES[c][1]}' end" for c, t in _TESTS.items())
_ISSUED = (
    f"select statement_id, position, concat_ws(',', {_CODES}) as codes, cast({_ERRORS} as integer) as errors, cast({_WARNINGS} as integer) as warnings,"
    f" round(greatest(0.0::double, least(1.0::double, {_MIXED} - 0.2::double * ({_ERRORS}) - 0.05::double * ({_WARNINGS}))), 4) as confidence, concat_ws(' | ', {_NOTES}) as notes from ({_CHECKED})"
)
_add(
    "validation_issues",
    lambda spark, sf_dir: validate.issues(with_balance(ledger(spark, sf_dir))),
    f"select statement_id, position, codes, errors, warnings, confidence, errors = 0 as valid, errors > 0 or warnings > 0 or confidence < 0.85 as review, notes from ({_ISSUED})",
)
_add(
    "reconciliation",
    lambda spark, sf_dir: validate.reconciliation(with_balance(ledger(spark, sf_dir))),
    "select statement_id, cast(net as double) as expected, cast(coalesce(closing, net) as double) as closing, cast(coalesce(closing, net) - net as double) as difference, abs(coalesce(closing, net) - net) < 0.01 as matches from"
    " (select statement_id, coalesce(sum(case when direction = 'credit' then abs(original_amount) else -abs(original_amount) end), 0) as net, max_by(running_balance, case when running_balance is not null then position end) as closing"
    f" from ({BALANCE_SQL}) group by statement_id)",
)
_add(
    "derived_balance",
    _on_ledger(lambda rows: validate.derived_balance(rows).select("statement_id", "position", F.col("derived_balance").cast("double").alias("derived_balance"))),
    "select statement_id, position, cast(sum(coalesce(case when direction = 'credit' then abs(original_amount) else -abs(original_amount) end, 0)) over (partition by statement_id order by position rows unbounded preceding) as double)"
    " as derived_balance from ledger",
)


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as statement_id", "cast(10000 as decimal(18,2)) as card_limit", "case when c_custkey % 3 = 0 then null else cast(c_acctbal as decimal(18,2)) end as available_limit",
        "case when c_custkey % 2 = 0 then cast(abs(c_acctbal) as decimal(18,2)) end as current_balance",
    )
    return validate.card_snapshot(rows)


_add(
    "card_utilization",
    _cards,
    "select statement_id, cast(u as double) as used, cast(f as double) as available, round(100.0::double * cast(u as double) / 10000.0::double, 1) as utilisation from (select statement_id, coalesce(b, 10000 - a) as u, coalesce(a, 10000 - b) as f from"
    " (select cast(c_custkey as varchar) as statement_id, case when c_custkey % 3 = 0 then null else cast(c_acctbal as decimal(18,2)) end as a, case when c_custkey % 2 = 0 then cast(abs(c_acctbal) as decimal(18,2)) end as b from customer))",
    base=False,
)

# memory and campaigns
_MEMORY_SQL = (
    f"select {text.merchant_key(D, 'merchant', 'cast(null as varchar)', 'description_raw')} as merchant_key, position, 'Custom ' || (position % 5) as category, 'Sub' as subcategory from ledger where position % 10 = 0"
)


def _corrections(rows: DataFrame) -> DataFrame:
    return memory.with_keys(rows.filter("position % 10 = 0")).selectExpr("merchant_key", "position", "concat('Custom ', position % 5) as category", "'Sub' as subcategory")


def _start(rows: DataFrame) -> DataFrame:
    return memory.with_keys(rows.filter("position % 10 = 0 and position % 3 = 0")).select("merchant_key").distinct().selectExpr(
        "merchant_key", "'Old' as category", "'Sub' as subcategory", "2 as times_confirmed"
    )


_UPSERT_SQL = (
    f"select k.merchant_key, coalesce(c.category, 'Old') as category, 'Sub' as subcategory, coalesce(c.n, 0) + coalesce(o.n, 0) as times_confirmed from (select distinct merchant_key from ({_MEMORY_SQL})) k"
    f" left join (select merchant_key, max_by(category, position) as category, count(*) as n from ({_MEMORY_SQL}) group by 1) c using (merchant_key)"
    f" left join (select distinct merchant_key, 2 as n from ({_MEMORY_SQL}) where position % 3 = 0) o using (merchant_key)"
)
_add("memory_upsert", _on_ledger(lambda rows: memory.upsert(_start(rows), _corrections(rows))), _UPSERT_SQL)
_KEYED = f"select *, {text.merchant_key(D, 'merchant', 'cast(null as varchar)', 'description_raw')} as merchant_key from ({_RULED})"
_add(
    "memory_join",
    _on_ledger(lambda rows: memory.categorised(rows, memory.last_corrections(_corrections(rows).filter("position % 100 = 0")))),
    f"select position, r.merchant_key, coalesce(m.category, {classify.rule_part(D, 'rule', 1)}) as category, case when m.category is not null then 'Sub' else {classify.rule_part(D, 'rule', 2)} end as subcategory,"
    f" case when m.category is not null then 1.0::double else coalesce({classify.rule_part(D, 'rule', 3)}, 0) end as score, (case when m.category is not null then 1.0::double else coalesce({classify.rule_part(D, 'rule', 3)}, 0) end) < 0.9 as review,"
    f" case when m.category is not null then 'memory' when rule is not null then 'rule' else 'review' end as origin from ({_KEYED}) r left join"
    f" (select merchant_key, max_by(category, position) as category from ({_MEMORY_SQL}) where position % 100 = 0 group by 1) m using (merchant_key)",
)
_add(
    "first_spellings",
    _on_ledger(memory.first_spellings),
    "select lower(merchant) as name_key, min_by(merchant, position) as name, min(position) as first_position from ledger where nullif(trim(merchant), '') is not null group by 1",
)
_add("campaign_candidates", _on_ledger(lambda rows: memory.campaign_groups(rows, rows.filter("position % 100 = 0"))))

# questions
_ASKED = [*QUESTIONS, "Shop 12 coffee house payments", "what was 1,299.50 for"]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_ASKED)), "question_id int, question string")


_add("retrieval_topk", lambda spark, sf_dir: retrieval.retrieve(retrieval.index(ledger(spark, sf_dir)), _questions(spark)))
_add("find_merchant", lambda spark, sf_dir: retrieval.find_merchants(ledger(spark, sf_dir), _questions(spark)))



_add("header_map", lambda spark, sf_dir: headers.mapped(layouts.printed_headers(spark, sf_dir), memory.ratio))

_SHAPES = [
    "{n}", "({n})", "{n}CR", "{n} DR", "|{n}|", "AED{n}", "{k}", "A{k}", "TFR", "{d}-08-2026", "{d}/AUG/26", "2026-0{d}-1", "Aug.", "{d}", "September", "{k}00000/X-1", "salary {n}", "payment to {k}",
    "payment received fee", "{d}.12.2026 shop",
]
_WORD = "case " + " ".join(
    f"when o_orderkey % {len(_SHAPES)} = {i} then concat(" + ", ".join({"n": "cast(cast(o_totalprice as decimal(18,2)) as varchar(40))", "k": "cast(o_orderkey as varchar(40))", "d": "cast(o_orderkey % 40 as varchar(40))"}.get(part, f"'{part}'") for part in re.split(r"[{}]", shape)) + ")"
    for i, shape in enumerate(_SHAPES)
) + " end"
_add(
    "token_tests",
    lambda spark, sf_dir: table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_WORD} as word").selectExpr("o_orderkey", "word", *(f"{t(S, 'word')} as {n}" for n, t in tokens.TESTS.items())),
    "select o_orderkey, word, " + ", ".join(f"{t(D, 'word')} as {n}" for n, t in tokens.TESTS.items()) + f" from (select o_orderkey, {_WORD} as word from orders)",
    base=False,
)

# report tables
_add(
    "overview_export",
    _on_ledger(report.overview_export),
    f"select 'Summary' as section, item, amount, cast(null as double) as percentage, 'AED' as currency from (select unnest(['Income', 'Expenses', 'Net']) as item, unnest([i, e, round(i - e, 2)]) as amount from (select {total(CREDIT)} as i, {total('not ' + CREDIT)} as e from ledger))"
    " union all select 'Category', category, cast(s as double), round(100.0::double * cast(s as double) / nullif(cast(sum(s) over () as double), 0), 2), 'AED'"
    f" from (select {CATEGORY} as category, sum({AMOUNT}) as s from ledger where direction = 'debit' group by 1)",
)
_add(
    "merchant_concentration",
    _on_ledger(report.merchant_concentration),
    f"select name, cast(s as double) as spent, n as transactions, round(100.0::double * cast(s as double) / (select cast(sum({AMOUNT}) as double) from ledger where not {CREDIT}), 2) as share from"
    f" (select {MERCHANT} as name, sum({AMOUNT}) as s, count(*) as n from ledger where not {CREDIT} group by 1) order by s desc, name limit 12",
)
_add(
    "report_signals",
    _on_ledger(report.signals),
    "select count(*) as transactions, count(*) filter (requires_review) as to_review, count(*) filter (nullif(trim(category), '') is null) as without_category, count(*) filter (transaction_date is null) as without_date,"
    " min(transaction_date) as first_date, max(transaction_date) as last_date from ledger",
)
_add(
    "ranked_rows",
    _on_ledger(report.ranked_rows),
    "select statement_id, position, amount, cast(r as integer) as rank, round(amount / nullif(m, 0), 4) as width from (select statement_id, position, amount, row_number() over (partition by statement_id order by amount desc, position) as r,"
    f" max(amount) over (partition by statement_id) as m from (select statement_id, position, cast({AMOUNT} as double) as amount from ledger)) where r <= 20",
)

# documents and layout
_PAGE_TEXT = "lower(text)"
_add(
    "doc_keyword_score",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{classify.signal_score(S, _PAGE_TEXT, CARD_SIGNALS)} as card_score", f"{classify.signal_score(S, _PAGE_TEXT, BANK_SIGNALS)} as bank_score", f"{classify.document_kind(S, _PAGE_TEXT)} as kind",
        f"{classify.currency(S, 'text')} as currency",
    ),
    f"select doc_id, {classify.signal_score(D, _PAGE_TEXT, CARD_SIGNALS)} as card_score, {classify.signal_score(D, _PAGE_TEXT, BANK_SIGNALS)} as bank_score, {classify.document_kind(D, _PAGE_TEXT)} as kind, {classify.currency(D, 'text')} as currency from documents",
    base=False,
)
_add(
    "metadata_rows",
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{classify.is_metadata(S, 'text')} as is_metadata"),
    f"select conv_id, turn, {classify.is_metadata(D, 'text')} as is_metadata from conversations",
    base=False,
)


def _statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as statement lines, one page per customer."""
    line = F.concat_ws(
        " ", F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string")),
        F.concat(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.when(F.col("o_orderstatus") == "P", "CR").otherwise("")),
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.struct(F.col("o_orderkey").alias("k"), line.alias("line")).alias("r"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("text")).withColumn("page_number", F.lit(1))


_add(
    "line_extract",
    lambda spark, sf_dir: layout.text_transactions(_statement_pages(spark, sf_dir), 2026).select("doc_id", "transaction_date", "description_raw", F.col("amount").cast("double").alias("amount"), "direction"),
    "select cast(o_custkey as varchar) as doc_id, cast(o_orderdate as date) as transaction_date, 'ORDER ' || o_orderkey as description_raw, cast(cast(o_totalprice as decimal(18,2)) as double) as amount,"
    " case when o_orderstatus = 'P' then 'credit' else 'debit' end as direction from orders",
    base=False,
)


def _statement_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out as positioned words under a header: date, description, debit, credit, balance."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    amount = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    rows = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).withColumn("page_number", F.floor((F.col("r") - 1) / 30).cast("int") + 1).withColumn("top", ((F.col("r") - 1) % 30 + 1) * 12.0)
    word = lambda t, x, dy=0.0: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 40)).alias("x1"), (F.col("top") + dy).alias("top"))
    credit = F.col("o_orderstatus") == "P"
    cells = F.array(word(F.date_format("o_orderdate", "dd/MM/yyyy"), 20), word(F.lit("ORDER"), 120, 1.5), word(F.col("o_orderkey").cast("string"), 161, 3.0), word(F.when(~credit, amount), 300), word(F.when(credit, amount), 400))
    body = rows.select(F.col("o_custkey").cast("string").alias("doc_id"), "page_number", F.explode(cells).alias("w")).select("doc_id", "page_number", "w.*").filter("text is not null")
    header = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 40)).alias("x1"), F.lit(0.0).alias("top")) for t, x in (("Date", 20), ("Description", 120), ("Debit", 300), ("Credit", 400))])
    heads = body.select("doc_id", "page_number").distinct().withColumn("w", F.explode(header)).select("doc_id", "page_number", "w.*")
    return body.unionByName(heads).withColumn("bottom", F.col("top") + 8)


_add(
    "word_rows",
    lambda spark, sf_dir: layout.raw_rows(_statement_words(spark, sf_dir)).selectExpr(
        "doc_id", f"{values.parsed_date(S, 'transaction_date')} as transaction_date", "description", f"cast({values.parsed_amount(S, 'debit')} as double) as debit", f"cast({values.parsed_amount(S, 'credit')} as double) as credit"
    ),
    "select cast(o_custkey as varchar) as doc_id, cast(o_orderdate as date) as transaction_date, 'ORDER ' || o_orderkey as description, case when o_orderstatus <> 'P' then cast(cast(o_totalprice as decimal(18,2)) as double) end as debit,"
    " case when o_orderstatus = 'P' then cast(cast(o_totalprice as decimal(18,2)) as double) end as credit from orders",
    base=False,
)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    none = "cast(null as string)"
    return rows.selectExpr(
        "statement_id", "1 as page_number", "position", "date_text as transaction_date", "cast(posting_date as string) as posting_date", f"{none} as value_date", "description_raw as description", "amount_text as amount",
        f"{none} as debit", f"{none} as credit", f"{none} as balance", f"{none} as transaction_id", "'adapter' as source_file",
    )


def _canonical_sql() -> str:
    """The raw rows step by step: the statement's year, parsed values, merchant, direction, and what a row needs to stay."""
    year = D.extracted("raw_date", r"(?:19|20)[0-9]{2}")
    steps = [
        "select statement_id, position, date_text as raw_date, cast(posting_date as varchar) as raw_posting, coalesce(nullif(trim(description_raw), ''), '') as description_raw, amount_text as amount,"
        f" row_number() over (partition by statement_id order by position) as n, first_value(try_cast(nullif({year}, '') as integer) ignore nulls) over (partition by statement_id order by position"
        " rows between unbounded preceding and unbounded following) as _year from (select *, date_text as raw_date from ledger)",
        f"select *, {values.parsed_date(D, 'raw_date', '_year')} as _dated, {values.parsed_date(D, 'raw_posting', '_year')} as _posted, {values.signed_decimal(D, 'amount')} as _amount from s0",
        *(f"select *, {expression} as {name} from s{i + 1}" for i, (name, expression) in enumerate(text.merchant_columns(D, "description_raw"))),
    ]
    last = f"s{len(steps) - 1}"
    reward = f"coalesce({classify.transaction_type(D, 'description_raw', repr('debit'))} = 'cashback', false)"
    spaced = "concat(' ', description_raw, ' ')"
    steps.append(f"select *, case when {reward} or {values.marked_credit(D, 'amount')} then 'credit' else {classify.direction(D, spaced)} end as direction from {last}")
    points = "50" + "".join(f" + case when nullif(trim({c}), '') is not null then {w} else 0 end" for c, w in (("raw_date", 10), ("raw_posting", 5), ("description_raw", 10), ("amount", 10)))
    named = ", ".join(f"s{i} as ({step})" for i, step in enumerate(steps))
    return (
        f", {named} select statement_id, position, printf('TXN-%06d', n) as transaction_id, coalesce(_dated, _posted) as transaction_date, merchant_name as merchant, cast(abs(_amount) as double) as original_amount, direction,"
        f" {classify.transaction_type(D, 'description_raw', 'direction')} as transaction_type, {classify.channel(D, 'description_raw')} as transaction_channel, round(cast({points} as double) / 100, 2) as extraction_confidence"
        f" from s{len(steps) - 1} where coalesce(_dated, _posted) is not null and _amount is not null and description_raw <> '' and not {classify.is_metadata(D, 'description_raw')}"
    )


_add(
    "canonical_ledger",
    lambda spark, sf_dir: canonical.build_ledger(_raw(spark, sf_dir)).select(
        "statement_id", "position", "transaction_id", "transaction_date", "merchant", F.col("original_amount").cast("double").alias("original_amount"), "direction", "transaction_type", "transaction_channel",
        F.round("extraction_confidence", 2).alias("extraction_confidence"),
    ),
    _canonical_sql(),
)
ORACLE_SQL["canonical_ledger"] = ORACLE_SQL["canonical_ledger"].replace(") , s0 as (", "), s0 as (", 1)
_add(
    "taxonomy",
    lambda spark, sf_dir: spark.createDataFrame([(c, s) for c, subs in TAXONOMY.items() for s in subs], "category string, subcategory string"),
    "select * from (values " + ", ".join(f"('{c}', '{s}')" for c, subs in TAXONOMY.items() for s in subs) + ") t(category, subcategory)",
    base=False,
)
_add(
    "event_weekly_totals",
    lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"), F.count(F.lit(1)).alias("events")
    ),
    "select cast(date_trunc('week', ts) as date) as week, event_type, cast(sum(cast(value as decimal(18,2))) as double) as value, count(*) as events from events group by 1, 2",
    base=False,
)


# statements, categories and answers
_hits = lambda terms: " + ".join(f"max(case when contains(lower(description_raw), '{t}') then 1 else 0 end)" for t in terms)
_add(
    "card_flags",
    _on_ledger(statements.card_flags),
    f"select statement_id, said or (card >= 2 and card > bank) as is_card from (select statement_id, bool_or(statement_type = 'credit_card') as said, {_hits(statements.CARD_TERMS)} as card,"
    f" {_hits(statements.BANK_TERMS)} as bank from ledger group by 1)",
)
_add(
    "category_membership",
    lambda spark, sf_dir: statements.category_membership(memory.classified(ledger(spark, sf_dir)).selectExpr("position", "rule_category as category", "rule_subcategory as subcategory")),
    "select r.position, r.category, r.subcategory, m.n is not null as known, coalesce(list_contains(m.subs, r.subcategory), false) as fits, cast(coalesce(m.n, 0) as integer) as n_sub from"
    f" (select position, {classify.rule_part(D, 'rule', 1)} as category, {classify.rule_part(D, 'rule', 2)} as subcategory from ({_RULED})) r left join (values "
    + ", ".join(f"('{c}', {D.array(D.text(x) for x in subs)}, {len(subs)})" for c, subs in TAXONOMY.items())
    + ") m(category, subs, n) on r.category = m.category",
)
_add(
    "campaign_apply",
    _on_ledger(
        lambda rows: statements.apply_campaign(rows, memory.campaign_positions(rows, rows.filter("position % 100 = 0")), "Groceries").select("position", "category", "requires_review")
    ),
)
_add(
    "answers",
    _on_ledger(statements.answers),
    f"select unnest(['income', 'expenses', 'net', 'review']) as intent, unnest(['You received AED ' || {D.money('i')} || '.', 'You spent AED ' || {D.money('e')} || '.', 'Your net cash flow was AED ' || {D.money('i - e')} || '.',"
    f" r || ' transactions are for review.']) as answer from (select {total(CREDIT)} as i, {total('direction = ' + repr('debit'))} as e, count(*) filter (requires_review) as r from ledger)",
)


def _summary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of labels and amounts per customer."""
    amount = lambda e: f"format_number({e}, 2)"
    text = (
        f"concat_ws('\n', 'ACCOUNT SUMMARY', concat('Opening Balance ', {amount('abs(c_acctbal)')}, ' CR'), 'Card Limit', {amount('10000.0D')}, concat('Available Limit: AED ', {amount('abs(c_acctbal)')}),"
        f" concat('Total Payment Due ', {amount('c_custkey * 1.0D')}), concat('balance ', {amount('abs(c_acctbal) + 1')}, ' CR'), 'GRAND TOTAL', concat('x ', {amount('9.0D')}, ' CR'))"
    )
    return table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as doc_id", "1 as page_number", f"{text} as text")


_add(
    "statement_balances",
    lambda spark, sf_dir: statements.bank_balances(_summary_pages(spark, sf_dir)).selectExpr("doc_id", "cast(opening_balance as double) as opening_balance", "cast(closing_balance as double) as closing_balance"),
    "select cast(c_custkey as varchar) as doc_id, cast(cast(abs(c_acctbal) as decimal(18,2)) as double) as opening_balance, cast(cast(abs(c_acctbal) as decimal(18,2)) + 1 as double) as closing_balance from customer",
    base=False,
)
_add(
    "card_summary",
    lambda spark, sf_dir: statements.card_summary(_summary_pages(spark, sf_dir)).selectExpr(
        "doc_id", "cast(card_limit as double) as card_limit", "cast(available_limit as double) as available_limit", "cast(total_payment_due as double) as total_payment_due"
    ),
    "select cast(c_custkey as varchar) as doc_id, 10000.0::double as card_limit, cast(cast(abs(c_acctbal) as decimal(18,2)) as double) as available_limit, c_custkey::double as total_payment_due from customer",
    base=False,
)


# headers in page texts; the SQL joins windows with the phrases instead of testing each field
_PHRASES = ", ".join(f"({i}, {D.text(name)}, {D.text(field)}, {D.text(text_structure.pattern([name]))})" for i, (name, field) in enumerate(text_structure.phrases()))
_add(
    "text_structure",
    lambda spark, sf_dir: text_structure.structure(
        table(spark, sf_dir, "customer").selectExpr(*headed_pages(S)).select("doc_id", F.posexplode("pages").alias("n", "text")).selectExpr("doc_id", "n + 1 as page_number", "text")
    ).withColumn("columns", F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit("="), c["field"])), ", ")),
    f"with p as (select doc_id, unnest(pages) as text, generate_subscripts(pages, 1) as page from (select {', '.join(headed_pages(D))} from customer)),"
    " l as (select doc_id, page, n, trim(line) as line from (select doc_id, page, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from p) where trim(line) <> ''),"
    " w as (select doc_id, page, n, concat_ws(' | ', line, lead(line, 1) over o, lead(line, 2) over o, lead(line, 3) over o) as header from l window o as (partition by doc_id, page order by n)),"
    r" t as (select *, trim(regexp_replace(regexp_replace(replace(lower(replace(header, ' | ', ' ')), 'trxn.', 'trxn'), '[^a-z0-9#./\s-]', ' ', 'g'), '\s+', ' ', 'g')) as plain from w),"
    f" h as (select t.*, f.* from t join (values {_PHRASES}) f(k, name, field, pattern) on regexp_matches(plain, pattern)),"
    " s as (select doc_id, page, n, header, list_distinct(list(field)) as fs, string_agg(name || '=' || field, ', ' order by k) as columns from h group by all),"
    " r as (select *, len(fs) + case when list_contains(fs, 'transaction_date') and list_has_any(fs, ['description', 'amount', 'debit', 'credit']) then 3 else 0 end"
    " + list_contains(fs, 'posting_date')::int + list_contains(fs, 'value_date')::int as score from s),"
    " b as (select * from r where score >= 4 qualify row_number() over (partition by doc_id order by score desc, page, n) = 1)"
    " select d.doc_id, cast(page as integer) as header_page, header as header_text, coalesce(columns, '') as columns, coalesce(list_has_any(fs, ['debit', 'credit']), false) as has_debit_credit,"
    " coalesce(list_has_all(fs, ['debit', 'credit']), false) as has_separate_debit_credit, coalesce(list_contains(fs, 'amount') and not list_has_all(fs, ['debit', 'credit']), false) as has_single_amount,"
    " coalesce(list_contains(fs, 'balance'), false) as has_balance, coalesce(list_contains(fs, 'transaction_id'), false) as has_transaction_id,"
    " coalesce(round((list_has_any(fs, ['transaction_date', 'posting_date', 'value_date'])::int + list_contains(fs, 'description')::int + list_has_any(fs, ['amount', 'debit', 'credit'])::int) / 3.0::double, 2), 0.0::double) as confidence"
    " from (select distinct doc_id from p) d left join b on b.doc_id = d.doc_id",
    base=False,
)


# questions answered in sentences; merchants are named by containment only, no name is just like one of these questions
def _said(x: str) -> str:
    return f"(select c from cur) || ' ' || {D.money(x)}"


def _few(intent: str, rows: str, order: str) -> str:
    line = f"'- **' || coalesce(nullif(trim(merchant), ''), nullif(trim(description_raw), ''), 'Unknown') || '** — ' || {_said('a')} || ' on ' || coalesce(cast(transaction_date as varchar), 'date unavailable')"
    return f"(select 'Your {intent} outgoing transactions are:' || chr(10) || chr(10) || string_agg({line}, chr(10) order by {order}, position) from (select *, {AMOUNT} as a from ledger where direction = 'debit' {rows} order by {order}, position limit 5))"


_SENTENCES = {
    "summary": f"(select 'This statement contains **' || n || ' transactions**, with **' || {_said('i')} || ' received** and **' || {_said('e')} || ' spent**. Net cash flow is **' || {_said('i - e')} || '**. Your largest merchant concentration is **'"
    f" || (select name || ' — ' || {_said('spent')} from top) || '**.' from tot)",
    "income": f"(select 'Total money received in this statement: **' || {_said('i')} || '**.' from tot)",
    "expenses": f"(select 'Total money spent in this statement: **' || {_said('e')} || '**.' from tot)",
    "net": f"(select 'Your net cash flow is **' || {_said('abs(i - e)')} || '** (' || case when i >= e then 'positive' else 'negative' end || ').' from tot)",
    "review": "(select '**' || r || ' transaction(s)** are marked for review, including **0 possible duplicate(s)**.' from tot)",
    "top_merchant": f"(select 'Your highest-spending merchant is **' || name || '**, with **' || {_said('spent')} || '** across **' || transactions || ' transaction(s)**.' from top)",
    "largest_transaction": _few("largest", "", "a desc"),
    "smallest_transaction": _few("smallest", "and original_amount <> 0", "a"),
    "identity": D.text(answers.NOTHING["identity"]),
    "category_spend": "case when q_category is null then (select 'The largest inferred spending areas are:' || chr(10) || chr(10) || string_agg('- **' || category || '** — ' || "
    + _said("spent")
    + " || ' (' || n || ' transactions)', chr(10) order by spent desc, category) from (select * from kinds order by spent desc, category limit 5)) else coalesce((select 'You spent **' || "
    + _said("sum(spent)")
    + " || '** on **' || min(category) || '** across **' || sum(n) || ' transaction(s)**. ' || case when bool_or(inferred) then 'This is inferred from merchant/description text.' else 'This category is present in the extracted statement data.' end"
    " from kinds where lower(category) = lower(q_category) having count(*) > 0), 'I couldn''t identify any transactions that can be attributed to **' || q_category || '** in this statement.') end",
}
_add(
    "question_answers",
    lambda spark, sf_dir: answers.answered(ledger(spark, sf_dir), _questions(spark)),
    f", cur as (select upper(original_currency) as c from ledger where original_currency <> '' group by 1 order by count(*) desc, min(position) limit 1), inf as ({_INFERRED}),"
    f" kinds as (select coalesce(i_category, 'Uncategorized') as category, cast(sum({AMOUNT}) as double) as spent, count(*) as n, bool_or(i_confidence < 1) as inferred from inf where direction = 'debit' group by 1),"
    f" top as (select {text.cleaned(D, 'coalesce(nullif(trim(merchant), ' + repr('') + '), description_raw)')} as name, cast(sum({AMOUNT}) as double) as spent, count(*) as transactions from ledger where direction = 'debit' group by 1 order by 2 desc, 1 limit 1),"
    f" tot as (select count(*) as n, {total(CREDIT)} as i, {total('direction = ' + repr('debit'))} as e, count(*) filter (requires_review) as r from ledger),"
    f" asked as (select question_id, q, {classify.question_category(D, 'q')} as q_category from (values {', '.join(f'({i}, {D.text(q.lower())})' for i, q in enumerate(_ASKED))}) v(question_id, q)),"
    f" known as (select *, {classify.intent(D, 'q', 'q_category')} as intent from asked),"
    f" shops as (select merchant, lower(merchant) as about, {total('direction = ' + repr('debit'))} as spent, count(*) filter (direction = 'debit') as n from ledger where trim(merchant) <> '' group by 1)"
    " select question_id, intent, case when intent = 'category_spend' then lower(coalesce(q_category, '')) when intent = 'merchant_spend' then coalesce(about, '') else '' end as about, case intent "
    + " ".join(f"when '{i}' then {sentence}" for i, sentence in _SENTENCES.items())
    + f" when 'merchant_spend' then 'You spent **' || {_said('spent')} || '** at **' || merchant || '** across **' || n || ' transaction(s)**.' end as answer from known left join shops on intent = 'merchant_spend' and contains(q, about)",
)


# page texts to a validated ledger; the SQL goes out from the orders that were printed
_HEADS = {0: "Credit Card Statement\nCard Limit AED 5,000\n", 1: "Savings Account Statement in INR\n", 2: "Dear customer\n"}


def _printed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS.values()]), (F.col("doc_id").cast("long") % 3 + 1).cast("int"))
    named = F.regexp_replace(F.regexp_replace("text", r"ORDER (\d*7) ", "SALARY CREDIT $1 "), r"ORDER (\d*3) ", "NETFLIX.COM ONLINE $1 ")
    return _statement_pages(spark, sf_dir).withColumn("text", F.concat(head, named))


_add(
    "statement_pipeline",
    lambda spark, sf_dir: statement_pipeline.ledger_of_pages(_printed_statements(spark, sf_dir)).select(
        "statement_id", "transaction_date", "posting_date", "description_raw", "merchant", F.col("original_amount").cast("double").alias("amount"), "original_currency", "statement_type", "direction",
        "transaction_type", "rule_category", "codes", "errors", "warnings", "confidence", "review",
    ),
    "select cast(o_custkey as varchar) as statement_id, day as transaction_date, day as posting_date, story as description_raw, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(story, '.COM', '.com'), ' ')], ' ') as merchant,"
    " amount, currency as original_currency, kind as statement_type, case when received then 'credit' else 'debit' end as direction, case when o_orderkey % 10 = 7 then 'salary' when received then 'other' else 'purchase' end as transaction_type,"
    " case when o_orderkey % 10 = 3 then 'Entertainment' end as rule_category, case when currency = 'UNKNOWN' then 'UNKNOWN_CURRENCY' else '' end as codes, cast(0 as integer) as errors, cast(currency = 'UNKNOWN' as integer) as warnings,"
    " case when currency = 'UNKNOWN' then 0.8::double else 0.85::double end as confidence, currency = 'UNKNOWN' as review from (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, cast(cast(o_totalprice as decimal(18,2)) as double) as amount,"
    " o_orderstatus = 'P' or o_orderkey % 10 = 7 as received, ['AED', 'INR', 'UNKNOWN'][o_custkey % 3 + 1] as currency, ['credit_card', 'bank_account', 'unknown'][o_custkey % 3 + 1] as kind,"
    " case o_orderkey % 10 when 7 then 'SALARY CREDIT ' when 3 then 'NETFLIX.COM ONLINE ' else 'ORDER ' end || o_orderkey as story from orders)",
    base=False,
)

# restoring a backup
def _backup_lines(rows: DataFrame) -> DataFrame:
    """The ledger as JSON records: some cut off, some with a word for an amount, some without a statement."""
    names = [n for n in (f.split()[0] for f in restore.LEDGER_JSON.split(", ")) if n in rows.columns]
    whole = F.to_json(F.struct(*(F.expr(f"if(position % 23 = 0, null, {n})" if n == "statement_id" else n).alias(n) for n in names)))
    worded = F.to_json(F.struct(*(F.lit("many").alias(n) if n == "original_amount" else F.col(n) for n in names)))
    record = F.when(F.expr("position % 17 = 0"), F.expr("substring(r, 1, length(r) - 9)")).when(F.expr("position % 19 = 0"), worded).otherwise(F.col("r"))
    return rows.withColumn("r", whole).select("position", record.alias("record"))


_add(
    "ledger_restore",
    _on_ledger(lambda rows: restore.records(_backup_lines(rows)).select(
        "position", "reason", *(F.expr(f"if(reason is null, {e}, null)").alias(n) for n, e in (("statement_id", "row.statement_id"), ("merchant", "row.merchant"), ("original_amount", "cast(row.original_amount as double)"), ("transaction_date", "row.transaction_date")))
    )),
    "select position, reason, case when reason is null then statement_id end as statement_id, case when reason is null then merchant end as merchant, case when reason is null then cast(original_amount as double) end as original_amount,"
    " case when reason is null then transaction_date end as transaction_date from (select *, case when position % 17 = 0 or position % 19 = 0 then 'malformed' when position % 23 = 0 or original_amount is null then 'incomplete' end as reason from ledger)",
)
_add(
    "restored_categories",
    _on_ledger(lambda rows: restore.with_categories(rows).select("position", "category")),
    f"select position, case when bool_or(coalesce(trim(category), '') = '') over (partition by statement_id) then {classify.rule_part(D, 'rule', 1)} else category end as category from ({_RULED})",
)

QUERIES |= layouts.QUERIES
ORACLE_SQL |= layouts.ORACLE_SQL
