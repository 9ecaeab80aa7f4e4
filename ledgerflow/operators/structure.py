"""The table of a statement found from positioned words: header bands, stacked headers, fragmented headers, choice of page
(STR1-16, STR18-23, LAY9-10, ETL2).

A word can only read as a header if it is a known phrase or holds a word that speaks for a field, so few different texts
are compared by similarity and few words of a page are left.  These meet as one array per page; bands, stacks and
columns are folds over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import headers
from ledgerflow.functions import tokens as rules
from ledgerflow.functions.columns import computed
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.operators.regions import IGNORED, ordered_rows, physical_rows, placed_words

#: Tops of a header band lie within this of the band's mean; stacked words within this of each other.
BAND = 14.0
STACK = 18.0
# Overlap and score that make two words one header; distance of centres that makes two columns one.
OVERLAP, LEAST, CENTRES, NEAR = 0.55, 0.70, 0.80, 12.0
# Words of a financial header, of which a page needs one before its rows are searched for a fragmented one.
SIGNALS = [
    "date", "value", "posting", "post", "transaction", "trans", "tran", "txn", "reference", "ref", "description", "details", "particulars", "narration", "amount", "debit",
    "credit", "withdrawal", "withdrawals", "deposit", "deposits", "balance", "opening", "closing",
]
# What common header terms mean in a fragmented header.
ALIASES = {
    "particulars": "description", "narration": "description", "narrative": "description", "details": "description", "description": "description", "withdrawal": "debit",
    "withdrawals": "debit", "debit": "debit", "debits": "debit", "deposit": "credit", "deposits": "credit", "credit": "credit", "credits": "credit", "balance": "balance",
    "closing balance": "balance", "running balance": "balance", "available balance": "balance", "date": "transaction_date", "transaction date": "transaction_date",
    "tran date": "transaction_date", "txn date": "transaction_date", "value date": "value_date", "posting date": "posting_date", "post date": "posting_date",
    "tran id": "transaction_id", "txn id": "transaction_id", "transaction id": "transaction_id", "reference": "transaction_id", "reference no": "transaction_id",
    "reference number": "transaction_id", "amount": "amount", "transaction amount": "amount", "money out": "debit", "money in": "credit",
}
# Rows that are no transactions whatever they hold.
NO_EVIDENCE = ["opening balance", "closing balance", "balance forward", "brought forward", "carried forward", "statement summary"]

# Words that are one header together.
PHRASES = [
    "value date", "post date", "trxn. date", "txn date", "transaction date", "tran id", "transaction id", "account number", "opening balance", "closing balance", "current balance",
    "available balance", "effective available balance", "minimum payment", "payment due", "due date",
]
#: Words of one header are no farther apart than this.
CLOSE = 25.0

_PAGE = ["doc_id", "page_number"]
_DATES, _AMOUNTS = "('transaction_date', 'posting_date', 'value_date')", "('amount', 'debit', 'credit')"
_ENDS = r"(?U)^\s+|\s+$"
_COLUMN = "header string, role string, x0 double, x1 double, top double, confidence double"
_has = "exists({c}, c -> c.role in {r})".format


def _speaking(df: DataFrame) -> DataFrame:
    """The rows of ``df`` whose text may map to a field: the similarity of a text without a signal word never suffices.

    Every phrase and signal word has two letters side by side, so most texts need no pattern; the plain text is made once."""
    signals = sorted({w for words in headers.SIGNALS.values() for w in words})
    phrases = sorted({p.replace("_", " ") for ps in headers.PHRASES.values() for p in ps})
    made = computed(df.filter(F.lower("text").rlike("[a-z]{2}")), _plain=headers.plain(F.regexp_replace("text", _ENDS, "")))
    return made.filter(F.col("_plain").isin(*phrases) | F.exists(F.split("_plain", " "), lambda w: w.isin(*signals))).drop("_plain")


def header_words(words: DataFrame) -> DataFrame:
    """The words of ``words`` that read as a header by themselves, with role and confidence (STR5)."""
    placed = words.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), "text",
        *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top")), F.coalesce("bottom", "top").cast("double").alias("bottom"),
    ).filter("x0 is not null and x1 is not null and top is not null")
    may = _speaking(placed).withColumn("text", F.regexp_replace("text", _ENDS, "")).filter(~F.upper("text").isin(*IGNORED))
    return may.withColumn("r", headers.header_roles(F.array("text"))[0]).select("*", "r.role", "r.confidence").drop("r").filter("role is not null")


def _structure_score(cols: str) -> str:
    """STR10."""
    parts = [
        f"if({_has(c=cols, r=_DATES)}, 0.25D, 0D)", f"if({_has(c=cols, r="('description')")}, 0.25D, 0D)", f"if({_has(c=cols, r=_AMOUNTS)}, 0.25D, 0D)", f"if({_has(c=cols, r="('balance')")}, 0.15D, 0D)",
        f"if({_has(c=cols, r="('transaction_id', 'posting_date', 'value_date')")}, 0.10D, 0D)",
    ]
    return f"least(({' + '.join(parts)}) * (0.80D + aggregate({cols}, 0D, (s, c) -> s + c.confidence) / size({cols}) * 0.20D), 1D)"


def _distinct_columns(cols: str, near: float) -> str:
    """Of columns of one role whose centres are near, the one of more confidence, in the place of the first (STR9)."""
    centre = "({0}.x0 + {0}.x1) / 2".format
    at = f"array_position(transform(acc, o -> o.role = c.role and abs({centre('o')} - {centre('c')}) <= {near}D), true)"
    step = f"if({at} = 0, concat(acc, array(c)), transform(acc, (o, i) -> if(i = {at} - 1 and c.confidence > o.confidence, c, o)))"
    return f"aggregate({cols}, cast(array() as array<struct<{_COLUMN.replace(' ', ': ')}>>), (acc, c) -> {step})".replace(",: ", ", ")


def _date_places(words: str) -> str:
    return f"transform(filter({words}, w -> upper(w.text) = 'DATE'), w -> struct((w.x0 + w.x1) / 2 as centre, w.top as top))"


def header_bands(words: DataFrame) -> DataFrame:
    """The densest band of header words of each page: doc_id, page_number, band (words by top and left end), band_score, and
    the places of the page's words "Date" (STR6-7).

    From top to bottom a word joins the first band whose mean top is within ``BAND``.  A band scores for its words, for
    dates, description, amounts, balance and reference, and for confidence; on ties the one of more words, then the upper."""
    word = F.struct("top", "x0", "x1", "bottom", "text", "role", "confidence")
    pages = header_words(words).groupBy(*_PAGE).agg(F.array_sort(F.collect_list(word)).alias("ws"))
    hit = f"array_position(transform(acc, c -> abs(w.top - c.total / c.n) <= {BAND}D), true)"
    grown = f"transform(acc, (c, i) -> if(i = {hit} - 1, named_struct('total', c.total + w.top, 'n', c.n + 1, 'words', concat(c.words, array(w))), c))"
    kind = "struct<top: double, x0: double, x1: double, bottom: double, text: string, role: string, confidence: double>"
    none = f"cast(array() as array<struct<total: double, n: int, words: array<{kind}>>>)"
    fold = f"aggregate(ws, {none}, (acc, w) -> if({hit} = 0, concat(acc, array(named_struct('total', w.top, 'n', 1, 'words', array(w)))), {grown}))"
    pages = computed(pages, bands=fold)
    mean = "aggregate(c.words, 0D, (s, w) -> s + w.confidence) / c.n"
    has = lambda r: _has(c="c.words", r=r)
    score = (
        f"least(c.n * 0.12D, 0.60D) + if({has(_DATES)}, 0.40D, 0D) + if({has("('description')")}, 0.40D, 0D) + if({has(_AMOUNTS)}, 0.40D, 0D)"
        f" + if({has("('balance')")}, 0.20D, 0D) + if({has("('transaction_id')")}, 0.10D, 0D) + {mean} * 0.20D"
    )
    pages = computed(pages, best=f"array(array_max(transform(bands, (c, i) -> named_struct('score', {score}, 'n', c.n, 'first', -i))))")
    return pages.select(*_PAGE, F.expr("get(bands, -try_element_at(best, 1).first).words").alias("band"), F.expr("round(try_element_at(best, 1).score, 4)").alias("band_score"), F.expr(_date_places("ws")).alias("dates"))


def stacked_headers(bands: DataFrame) -> DataFrame:
    """The headers of each page's band, a word over another one made one header: doc_id, page_number, headers, dates (STR8).

    Words of ``bands`` are taken by top and left end.  A word goes with the lower word, not taken yet, that scores best for
    overlap, centre and distance, from ``LEAST`` on, if both together read as a header; else it stands alone."""
    pair = (
        "struct(get(band, i) as a, get(band, j) as b, get(band, j).top - get(band, i).top as gap,"
        " greatest(get(band, i).x1 - get(band, i).x0, 1D) as wa, greatest(get(band, j).x1 - get(band, j).x0, 1D) as wb, i as i, j as j)"
    )
    every = f"flatten(transform(sequence(0, size(band) - 1), i -> transform(filter(sequence(0, size(band) - 1), j -> j > i), j -> {pair})))"
    rows = computed(bands.filter("size(band) > 0"), pairs=every)
    overlap = "greatest(0D, least(p.a.x1, p.b.x1) - greatest(p.a.x0, p.b.x0)) / least(p.wa, p.wb)"
    centre = "abs((p.a.x0 + p.a.x1) / 2 - (p.b.x0 + p.b.x1) / 2) / greatest(p.wa, p.wb)"
    rated = f"struct(p.i as i, p.j as j, concat(p.a.text, ' ', p.b.text) as text, p.gap as gap, {overlap} as overlap, {centre} as centre)"
    rows = computed(rows, rated=f"transform(filter(pairs, p -> p.gap > 0 and p.gap <= {STACK}D), p -> {rated})")
    score = f"p.overlap * 0.60D + greatest(0D, 1D - least(p.centre, 1D)) * 0.25D + greatest(0D, 1D - p.gap / {STACK}D) * 0.15D"
    fits = f"filter(transform(rated, p -> struct(p.i as i, p.j as j, p.text as text, p.overlap as overlap, p.centre as centre, {score} as score)), p -> p.overlap >= {OVERLAP}D and p.centre <= {CENTRES}D)"
    rows = computed(rows, fits=fits).drop("pairs", "rated")
    rows = computed(rows, reads=headers.header_roles(F.col("fits.text")))
    rows = computed(rows, stacks="transform(fits, (p, n) -> struct(p.i as i, p.j as j, p.text as text, p.score as score, get(reads, n) as r))")
    best = "array_max(transform(filter(stacks, p -> p.i = i and p.score > 0 and not array_contains(acc.used, p.j)), p -> struct(p.score as score, -p.j as j, p.text as text, p.r as r)))"
    alone = "struct(get(band, i).text as header, get(band, i).role as role, get(band, i).x0 as x0, get(band, i).x1 as x1, get(band, i).top as top, get(band, i).confidence as confidence)"
    low = lambda c, f: f"{f}(get(band, i).{c}, get(band, -b.j).{c})"
    both = f"struct(b.text as header, b.r.role as role, {low('x0', 'least')} as x0, {low('x1', 'greatest')} as x1, {low('top', 'least')} as top, b.r.confidence as confidence)"
    joined = f"b.score >= {LEAST}D and b.r.role is not null"
    taken = f"struct(concat(acc.used, if(coalesce({joined}, false), array(i, -b.j), array(i))) as used, concat(acc.found, array(if(coalesce({joined}, false), {both}, {alone}))) as found)"
    # the best partner is bound by a lambda of its own, so it is searched once
    step = f"if(array_contains(acc.used, i), acc, get(transform(array({best}), b -> {taken}), 0))"
    start = f"struct(cast(array() as array<int>) as used, cast(array() as array<struct<{_COLUMN.replace(' ', ': ').replace(',: ', ', ')}>>) as found)"
    rows = computed(rows, headers=f"aggregate(sequence(0, size(band) - 1), {start}, (acc, i) -> {step}, acc -> acc.found)")
    return rows.select(*_PAGE, "headers", "dates")


def _chosen(pages: DataFrame, near: float) -> DataFrame:
    """Pages whose headers make a table: a date, and a description or an amount; with columns from left to right (STR9)."""
    ordered = "array_sort(headers, (a, b) -> case when a.x0 < b.x0 then -1 when a.x0 > b.x0 then 1 when a.top < b.top then -1 when a.top > b.top then 1 else 0 end)"
    rows = computed(pages, cols=_distinct_columns(ordered, near))
    return rows.filter(f"{_has(c='cols', r=_DATES)} and ({_has(c='cols', r="('description')")} or {_has(c='cols', r=_AMOUNTS)})")


def primary_pages(words: DataFrame) -> DataFrame:
    """Pages with a table by their header band: doc_id, page_number, columns, score (STR3)."""
    rows = computed(_chosen(stacked_headers(header_bands(words)), NEAR), score=_structure_score("cols"))
    return rows.select(*_PAGE, F.col("cols").alias("columns"), "score", "dates")


def _pages_dates(words: DataFrame) -> DataFrame:
    """The places of the words "Date" of each page that has one."""
    dates = placed_words(words.filter(F.upper("text").contains("DATE"))).filter("upper(text) = 'DATE'")
    return dates.groupBy(*_PAGE).agg(F.collect_list(F.expr("struct((x0 + x1) / 2 as centre, top as top)")).alias("dates"))


def fragmented_pages(words: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Pages with a table by a header in pieces: doc_id, page_number, columns, score, transaction_rows (STR4, STR12-16, STR19).

    Up to four rows in a row may be the header.  Words near a group's centre join it, a group's words together name a
    column, else its surest word does.  Two rows below it, or more, must have a date and a number; up to 100 count.  The
    best score wins, then more such rows, more columns, the lower band.  ``every`` holds ``words`` and may hold other pages;
    the places of the words "Date" are read from it."""
    rows = physical_rows(words)
    gate = F.exists("tokens", lambda t: F.lower(t["text"]).isin(*SIGNALS))
    no_row = " or ".join(f"contains(line, '{t}')" for t in NO_EVIDENCE)
    rows = computed(rows, gate=gate, line="lower(array_join(transform(tokens, t -> t.text), ' '))", dated=f"exists(tokens, t -> {rules.header_date(S, 't.text')})", priced=f"exists(tokens, t -> {rules.plain_number(S, 't.text')})")
    page = "partition by doc_id, page_number"
    rows = rows.withColumn("counts", F.expr(f"dated and priced and not ({no_row})").cast("int"))
    rows = rows.withColumn("below", F.least(F.lit(100), F.coalesce(F.expr(f"sum(counts) over ({page} order by row rows between 1 following and unbounded following)"), F.lit(0))).cast("int"))
    rows = rows.withColumn("gate", F.expr(f"max(gate) over ({page}) and max(row) over ({page}) >= 2")).filter("gate")
    words_ = rows.select(*_PAGE, "row", "below", F.explode("tokens").alias("t")).select(*_PAGE, "row", "below", "t.*").filter(~F.upper("text").isin(*IGNORED, "/CR"))
    alias = lambda text: F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("/"), F.lit(" "))), r"\s+", " ")))
    named = _speaking(words_).withColumn("alias", alias(F.col("text")))  # what has an alias speaks
    named = named.withColumn("r", headers.header_roles(F.array("text"))[0]).withColumn("role", F.coalesce("r.role", "alias"))
    named = named.withColumn("confidence", F.when(F.col("r.role").isNotNull(), F.col("r.confidence")).otherwise(0.90)).filter("role is not null")
    word = F.struct("x0", "top", "x1", "text", "role", "confidence")
    lines = named.groupBy(*_PAGE, "row", "below").agg(F.collect_list(word).alias("ws"))
    ahead = lines.withColumn("next", F.expr(f"collect_list(struct(row, below, ws)) over ({page} order by row range between current row and 3 following)"))
    bands = ahead.select(*_PAGE, F.col("row").alias("first"), F.posexplode("next").alias("i", "last"), "next").filter("last.below >= 2")
    bands = bands.select(*_PAGE, "first", F.col("last.row").alias("end"), F.col("last.below").alias("transaction_rows"), F.expr("array_sort(flatten(transform(slice(next, 1, i + 1), r -> r.ws)))").alias("ws"))
    centre, middle = "(w.x0 + w.x1) / 2", "(g.x0 + g.x1) / 2"
    near = f"array_min(filter(transform(acc, (g, i) -> if(abs({centre} - {middle}) <= greatest(18D, (g.x1 - g.x0) * 1.5D), struct(abs({centre} - {middle}) as d, i as i), null)), x -> x is not null)).i"
    grown = "struct(least(g.x0, w.x0) as x0, greatest(g.x1, w.x1) as x1, concat(g.ws, array(w)) as ws)"
    join = f"get(transform(array({near}), at -> if(at is null, concat(acc, array(struct(w.x0 as x0, w.x1 as x1, array(w) as ws))), transform(acc, (g, i) -> if(i = at, {grown}, g)))), 0)"
    kind = "struct<x0: double, top: double, x1: double, text: string, role: string, confidence: double>"
    bands = computed(bands, groups=f"aggregate(ws, cast(array() as array<struct<x0: double, x1: double, ws: array<{kind}>>>), (acc, w) -> {join})")
    by_top = "array_sort(g.ws, (a, b) -> case when a.top < b.top then -1 when a.top > b.top then 1 when a.x0 < b.x0 then -1 when a.x0 > b.x0 then 1 else 0 end)"
    bands = computed(bands, ordered=f"transform(groups, g -> {by_top})")
    bands = computed(bands, texts="transform(ordered, ws -> array_join(transform(ws, w -> w.text), ' '))")
    bands = computed(bands, reads=headers.header_roles(F.col("texts")), aliases=F.transform("texts", alias))
    surest = "get(ws, -array_max(transform(ws, (w, i) -> struct(w.confidence as c, -i as i))).i)"
    role, place = "coalesce(get(reads, n).role, get(aliases, n))", "get(groups, n).x0 as x0, get(groups, n).x1 as x1, array_min(ws.top) as top"
    whole = f"struct(get(texts, n) as header, {role} as role, {place}, if(get(reads, n).role is not null, get(reads, n).confidence, 0.90D) as confidence)"
    alone = f"get(transform(array({surest}), w -> struct(w.text as header, w.role as role, {place}, w.confidence as confidence)), 0)"
    tables = computed(bands, headers=f"transform(ordered, (ws, n) -> if({role} is not null, {whole}, {alone}))")
    tables = computed(_chosen(tables, 15.0), base=_structure_score("cols"))
    tables = tables.withColumn("score", F.expr("least(base * 0.65D + least(transaction_rows / 10D, 1D) * 0.35D, 1D)"))
    best = F.max(F.struct("score", "transaction_rows", F.size("cols").alias("n"), "first", "end", "cols")).alias("b")
    found = tables.groupBy(*_PAGE).agg(best).select(*_PAGE, F.col("b.cols").alias("columns"), "b.score", "b.transaction_rows")
    dates = _pages_dates(words if every is None else every)
    return found.filter("doc_id is not null and page_number is not null").join(dates, _PAGE, "left").withColumn("dates", F.coalesce("dates", F.array()))


def structure_pages(words: DataFrame) -> DataFrame:
    """The table of each page that has one, by its header band, else by a header in pieces: columns, score, fragmented, and
    the places of the page's words "Date" (STR2)."""
    sure = primary_pages(words).withColumn("fragmented", F.lit(False))
    rest = words.join(sure.select(*_PAGE), _PAGE, "left_anti")
    other = fragmented_pages(rest, words).drop("transaction_rows").withColumn("fragmented", F.lit(True))
    return sure.unionByName(other).withColumn("score", F.round("score", 4))


def value_dates(pages: DataFrame) -> DataFrame:
    """``pages`` where an amount headed "Value" with the word "Date" below it is a value date (LAY10)."""
    under = "exists(dates, d -> abs(d.centre - (c.x0 + c.x1) / 2) <= 12 and d.top > c.top and d.top <= c.top + 20)"
    dated = "struct('Value Date' as header, 'value_date' as role, c.x0 as x0, c.x1 as x1, c.top as top, 1.0D as confidence)"
    return pages.withColumn("columns", F.expr(f"transform(columns, c -> if(lower(c.header) = 'value' and c.role = 'amount' and {under}, {dated}, c))"))


def document_columns(words: DataFrame) -> DataFrame:
    """The columns of each document, from its best page: the best score, then most columns, then the first page (STR1, LAY9).

    doc_id, page_number, header, role, x0, x1, top, confidence; a document without a table has none."""
    best = F.max(F.struct("score", F.size("columns").alias("n"), (-F.col("page_number")).alias("first"), "columns", "dates")).alias("b")
    chosen = structure_pages(words).groupBy("doc_id").agg(best).select("doc_id", (-F.col("b.first")).alias("page_number"), "b.columns", "b.dates")
    return value_dates(chosen).select("doc_id", "page_number", F.inline("columns"))


def statement_rows(words: DataFrame) -> DataFrame:
    """Transactions of positioned words: columns from the document's best page, rows from all of its pages (ETL2)."""
    return ordered_rows(words, document_columns(words))


def header_groups(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Words of each line that are one header together: doc_id, page_number, row, header, x0, x1, top, words (HDR9-12).

    From left to right the longest phrase wins whose words are close; a word that begins none stands alone.  A line is what
    lies within ``tolerance`` of its first word."""
    close = lambda n: " and ".join(f"get(tokens, i + {k}).x0 - get(tokens, i + {k - 1}).x1 <= {CLOSE}D" for k in range(1, n))
    named = lambda n: f"lower(array_join(transform(slice(tokens, i + 1, {n}), t -> t.text), ' ')) in ({', '.join(repr(p) for p in PHRASES if p.count(' ') == n - 1)})"
    size = "case " + " ".join(f"when i + {n} <= size(tokens) and {named(n)} and {close(n)} then {n}" for n in (3, 2)) + " else 1 end"
    rows = computed(physical_rows(words, tolerance, running_mean=False), sizes=f"transform(tokens, (t, i) -> {size})")
    part = "slice(tokens, n.i + 1, n.size)"
    step = "if(n.i < acc.next, acc, struct(n.i + n.size as next, concat(acc.found, array(n)) as found))"
    none = "struct(0 as next, cast(array() as array<struct<i: int, size: int>>) as found)"
    rows = computed(rows, found=f"aggregate(transform(sizes, (s, i) -> struct(i as i, s as size)), {none}, (acc, n) -> {step}, acc -> acc.found)")
    group = f"struct(array_join(transform({part}, t -> t.text), ' ') as header, array_min(transform({part}, t -> t.x0)) as x0, array_max(transform({part}, t -> t.x1)) as x1, array_min(transform({part}, t -> t.top)) as top, n.size as words)"
    return rows.select(*_PAGE, "row", F.expr(f"inline(transform(found, n -> {group}))"))
