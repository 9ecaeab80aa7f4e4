"""Questions over a ledger: intents, an index of words, scored retrieval, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import classify, text
from ledgerflow.functions.columns import computed
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.operators import metrics
from ledgerflow.operators.memory import ratio


def intents(questions: DataFrame) -> DataFrame:
    """Add ``category`` and ``intent`` of each ``question`` (QA2)."""
    rows = questions.withColumn("_q", F.expr("lower(trim(question))")).withColumn("q_category", F.expr(classify.question_category(S, "_q")))
    return rows.withColumn("intent", F.expr(classify.intent(S, "_q", "q_category"))).drop("_q")


def inferred_categories(ledger: DataFrame) -> DataFrame:
    """Add i_category and i_confidence: the row's own category (1.0), else the one of most keywords (CL1)."""
    low = "lower(concat_ws(' ', coalesce(merchant, ''), coalesce(description_raw, ''), coalesce(transaction_type, '')))"
    own = ~F.expr(text.uncategorised(S, "category"))
    names = ledger.columns
    rows = ledger.withColumn("_low", F.expr(low)).withColumn("_best", F.expr(classify.best_keywords(S, "_low")))
    return rows.select(
        *names,
        F.when(own, F.expr(text.cleaned(S, "category"))).otherwise(F.when(F.col("_best.h") > 0, F.col("_best.c"))).alias("i_category"),
        F.when(own, 1.0).when(F.col("_best.h") > 0, F.least((55 + 12 * F.col("_best.h")).cast("double") / 100, F.lit(0.9))).otherwise(0.0).alias("i_confidence"),
    )


def index(ledger: DataFrame) -> DataFrame:
    """Word sets of each row: merchant, description, category, all (QA1)."""
    rows = inferred_categories(ledger).select(
        "position",
        "statement_id",
        metrics.amount().alias("amount"),
        F.expr(text.cleaned(S, "merchant")).alias("merchant"),
        F.expr(text.cleaned(S, "description_raw")).alias("description"),
        F.coalesce("i_category", F.lit("")).alias("category"),
    )
    words = lambda c: F.expr(text.tokens(S, c))
    rows = rows.withColumn("merchant_words", words("merchant")).withColumn("description_words", words("description")).withColumn("category_words", words("category"))
    return rows.withColumn("words", F.array_sort(F.array_union(F.array_union("merchant_words", "description_words"), "category_words")))


def retrieve(indexed: DataFrame, questions: DataFrame, limit: int = 12, similar: float = 0.72) -> DataFrame:
    """The best rows of each question (question_id, question): question_id, position, score (QA3, TK5).

    A row scores by words it shares with the question, which are found through a join on words, never by comparing every
    row with every question; merchants whose whole name is much like the question join by merchant.  Amounts written in
    the question join by amount.  Ties go to the earlier row.  A row is read once for its words: only those that a question
    has leave it, with what its whole names say of that question.  Positions are unique.
    """
    asked = questions.select("question_id", F.lower("question").alias("q"), F.expr(text.tokens(S, "question")).alias("q_words"))
    word = lambda c: F.explode(c).alias("word")
    none = F.lit(None).cast("double")
    by_word = asked.select("question_id", "q", word("q_words"), none.alias("r"))
    numbers = asked.select("question_id", "q", F.explode(F.expr(r"regexp_extract_all(q, '[0-9][0-9,]*[.][0-9]{2}', 0)")).alias("n"))
    sums = numbers.select("question_id", "q", F.expr("concat('=', try_cast(replace(n, ',', '') as decimal(18,2)))").alias("word"), none.alias("r")).filter("word is not null").distinct()
    # whole merchant names like the question, on distinct names of nearly its length
    names = indexed.filter("merchant <> 'Unknown'").select("merchant").distinct().withColumn("c", F.expr(r"trim(regexp_replace(lower(merchant), '[^a-z0-9 ]', ' '))")).filter("c <> ''")
    joined = asked.select("question_id", "q", F.array_join("q_words", " ").alias("p")).filter("p <> ''")
    spans = joined.withColumn("n", F.explode(F.sequence(F.ceil(F.length("p") * similar / (2 - similar)).cast("int"), F.floor(F.length("p") * (2 - similar) / similar).cast("int"))))
    alike = spans.join(names.withColumn("n", F.length("c")), "n").withColumn("r", ratio("p", "c")).filter(F.col("r") >= similar)
    keys = by_word.unionByName(sums).unionByName(alike.select("question_id", "q", F.concat(F.lit("~"), "merchant").alias("word"), "r"))
    # a row's words, its amount and its merchant, worked out once
    weights = {"merchant_words": 5.0, "description_words": 1.5, "category_words": 3.0}
    rows = computed(indexed.select("position", "merchant", "description", "words", *weights, "amount"), keys="array_compact(concat(words, array(concat('=', cast(amount as decimal(18,2))), concat('~', merchant))))")
    found = rows.select("position", "merchant", "description", *weights, word("keys")).join(keys, "word")
    is_word = ~F.substring("word", 1, 1).isin("=", "~")
    weight = sum((F.when(F.array_contains(c, F.col("word")), w).otherwise(0.0) for c, w in weights.items()), F.lit(1.0))
    # whole names within the question: only rows that share a word with it can have one
    named = F.when((F.col("merchant") != "Unknown") & F.contains("q", F.lower("merchant")), 10.0).otherwise(0.0)
    told = F.when((F.col("description") != "Unknown") & (F.length("description") > 5) & F.contains("q", F.lower("description")), 6.0).otherwise(0.0)
    said = F.when(is_word, weight).when(F.startswith("word", F.lit("=")), 6.0)
    scored = found.select("question_id", "position", said.alias("said"), F.when(is_word, named + told).alias("whole"), (F.col("r") * 5).alias("like"))
    score = F.greatest(F.sum("said") + F.coalesce(F.max("whole"), F.lit(0.0)), F.max("like"))
    best = scored.groupBy("question_id", "position").agg(score.alias("score")).filter("score > 0")
    row = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "position"))
    return best.withColumn("rank", row).filter(F.col("rank") <= limit)


#: Least similarity of a merchant name that a question spells otherwise (fixed value).
ALIKE = 0.58
_PLAIN = r"trim(regexp_replace(lower({}), '[^a-z0-9 ]', ' '))"


def find_merchants(ledger: DataFrame, questions: DataFrame) -> DataFrame:
    """The longest merchant name that a question contains, the last by name on ties; without one the name most like the
    question, at a similarity of 0.58 or more, again the last by name on ties (QA6, TXT9).

    A question of n letters has at most n * (n + 1) / 2 stretches, so contained names are found by a join on stretches
    that names have as lengths, not by comparing each name with each question; similar names meet questions by length.
    """
    from ledgerflow.operators.memory import first_spellings

    names = first_spellings(ledger).select("name", "name_key", F.length("name_key").alias("n"))
    asked = questions.select("question_id", F.lower("question").alias("q"), F.expr(_PLAIN.format("question")).alias("p")).filter("q is not null")
    sizes = names.select("n").distinct()
    spans = asked.join(F.broadcast(sizes), F.expr("n <= length(q)"))  # one row a length of a name, of which there are few
    pieces = spans.select("question_id", F.explode(F.expr("array_distinct(transform(sequence(1, length(q) - n + 1), i -> substring(q, i, n)))")).alias("name_key"))
    met = pieces.join(names, "name_key").groupBy("question_id").agg(F.max(F.struct(F.length("name").alias("l"), "name"))["name"].alias("merchant"))
    rest = asked.join(met, "question_id", "left_anti").filter("p <> ''")
    shape = names.withColumn("c", F.expr(_PLAIN.format("name"))).filter("c <> ''").withColumn("cl", F.length("c"))
    # a ratio of r needs lengths within r / (2 - r) of each other; a name within the question, once plain, has similarity 1
    low, high = ALIKE / (2 - ALIKE), (2 - ALIKE) / ALIKE
    lengths = rest.withColumn("cl", F.explode(F.sequence(F.ceil(F.length("p") * low).cast("int"), F.floor(F.length("p") * high).cast("int"))))
    alike = lengths.join(shape, "cl").select("question_id", "name", ratio("p", "c").alias("r"))
    plain_sizes = shape.select("cl").distinct()
    inside = rest.join(F.broadcast(plain_sizes), F.expr("cl <= length(p)"))
    inside = inside.select("question_id", F.explode(F.expr("array_distinct(transform(sequence(1, length(p) - cl + 1), i -> substring(p, i, cl)))")).alias("c"))
    inside = inside.join(shape, "c").select("question_id", "name", F.lit(1.0).alias("r"))
    best = alike.unionByName(inside).filter(F.col("r") >= ALIKE).groupBy("question_id").agg(F.max(F.struct("r", "name"))["name"].alias("merchant"))
    return met.unionByName(best)


def merchants(ledger: DataFrame) -> DataFrame:
    """Debit totals and counts by merchant, by description where there is none (AG16)."""
    name = F.expr(text.cleaned(S, "coalesce(nullif(trim(merchant), ''), description_raw)")).alias("name")
    return ledger.filter(metrics.debit()).groupBy(name).agg(F.sum(metrics.amount()).cast("double").alias("spent"), F.count(F.lit(1)).alias("transactions"))


def categories(ledger: DataFrame) -> DataFrame:
    """Debit totals, counts and mean confidence by inferred category (AG17)."""
    rows = inferred_categories(ledger).filter(metrics.debit() & F.col("i_category").isNotNull())
    return rows.groupBy(F.col("i_category").alias("category")).agg(
        F.sum(metrics.amount()).cast("double").alias("spent"), F.count(F.lit(1)).alias("transactions"), F.round(F.avg(F.col("i_confidence").cast("decimal(6,4)").cast("double")), 2).alias("confidence")
    )


def answer(ledger: DataFrame, intent: str, category: str | None = None) -> DataFrame:
    """The evidence for an intent (QA7): which aggregate answers it."""
    if intent == "largest_transaction":
        return metrics.largest(ledger, 10, debits=True)
    if intent == "smallest_transaction":
        return metrics.smallest(ledger)
    if intent == "top_merchant":
        return merchants(ledger).orderBy(F.desc("spent"), "name").limit(5)
    if intent == "category_spend":
        found = categories(ledger)
        return found.filter(F.col("category") == category) if category else found
    if intent == "merchant_spend":
        return merchants(ledger)
    if intent == "review":
        return ledger.filter("requires_review").select("position", "statement_id")
    return metrics.retrieval_totals(ledger)
