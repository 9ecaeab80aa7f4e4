"""Rows of positioned words by nearness to their columns, with dates put together from their parts (LAY3, LAY5-8, DT2, ETL17-18).

A row is parsed by itself, in expressions over its tokens.  A date may be one word, or up to four next to each other, or
below each other.  Date columns take the nearest whole date within reach in turn; numbers go to amount columns in turn, or,
where debits and credits have columns of their own, by the least distance of all pairs, then of those left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import tokens as rules
from ledgerflow.functions.columns import computed
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.functions.vocabulary import METADATA_TERMS
from ledgerflow.operators.regions import DATES, IGNORED, NUMBERS, document_rows

#: Parts of a date stand within this of each other; below each other, within these of the last one's lower end and the first one's centre.
GAP, BELOW, CENTRE, TOLERANCE = 18.0, 14.0, 18.0, 4.0
#: A date farther than this from a column is not its value; a number, unless it lies within the column by INSIDE.
DATE_REACH, REACH, INSIDE = 80.0, 70.0, 5.0
#: What a number gains by lying within its column.
BONUS = 1000.0
#: Words this far below a header are data.
HEADER = 8.0

_MONTHS = {m: i + 1 for i, m in enumerate(rules.SHORT_MONTHS)} | {m: rules.SHORT_MONTHS.index(m[:3]) + 1 for m in rules.LONG_MONTHS}
_month = ("try_element_at(map(" + ", ".join(f"'{m}', {n}" for m, n in _MONTHS.items()) + "), {})").format


def date_text(x: str) -> str:
    """The date of a text as 'yyyy-mm-dd', '0001-mm-dd' where it has no year, else null (DT2).

    Whole dates have one separator throughout; a year of two digits lies in 1969 to 2068, after a month spelt otherwise
    (with a full stop, or "Sept") in 1950 to 2049."""
    n = f"regexp_replace(regexp_replace(trim({x}), '\\\\s+', ' '), '\\\\s*([/.-])\\\\s*', '$1')"
    part = lambda pattern, i: f"regexp_extract(d.n, '{pattern}', {i})"
    named = r"^(\\d{1,2})([ -])([A-Za-z]+)\\2(\\d{4}|\\d{2})$"
    numeric = r"^(\\d{1,2})([-/.])(\\d{1,2})\\2(\\d{4}|\\d{2})$"
    turned = r"^(\\d{4})([-/])(\\d{1,2})\\2(\\d{1,2})$"
    loose, short = r"^(\\d+) ([A-Za-z]+)\\.* (\\d+)$", r"^(\\d+) ([A-Za-z]+)\\.*$"
    year = lambda y, pivot: f"case when length({y}) = 4 then cast({y} as int) when cast({y} as int) > {pivot} then 1900 + cast({y} as int) else 2000 + cast({y} as int) end"
    iso = lambda y, m, d: f"date_format(try_cast(concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) as date), 'yyyy-MM-dd')"
    strict = f"lower({part(named, 3)}) in ({', '.join(repr(m) for m in _MONTHS if m != 'sept')})"
    late = f"case when length({part(loose, 3)}) > 4 then null when cast({part(loose, 3)} as int) <= 49 then 2000 + cast({part(loose, 3)} as int) when cast({part(loose, 3)} as int) < 100 then 1900 + cast({part(loose, 3)} as int) else cast({part(loose, 3)} as int) end"
    month = lambda pattern, i: _month(f"lower({part(pattern, i)})")
    day = f"case when length({part(short, 1)}) <= 9 then cast({part(short, 1)} as int) end"
    cases = [
        (f"rlike(d.n, '{named}') and ({strict})", iso(year(part(named, 4), 68), month(named, 3), part(named, 1))),
        (f"rlike(d.n, '{numeric}')", iso(year(part(numeric, 4), 68), part(numeric, 3), part(numeric, 1))),
        (f"rlike(d.n, '{turned}')", iso(part(turned, 1), part(turned, 3), part(turned, 4))),
    ]
    tried = f"coalesce({', '.join(f'case when {test} then {value} end' for test, value in cases)}, case when rlike(d.n, '{loose}') and {month(loose, 2)} is not null and try_cast({part(loose, 1)} as int) <= 31 then {iso(late, month(loose, 2), f'try_cast({part(loose, 1)} as int)')} end, case when rlike(d.n, '{short}') and {month(short, 2)} is not null and {day} between 1 and 31 then concat('0001-', lpad({month(short, 2)}, 2, '0'), '-', lpad({day}, 2, '0')) end)"
    return f"get(transform(array(struct({n} as n)), d -> if(length(d.n) between 4 and 32 and substring(d.n, 1, 1) between '0' and '9', {tried}, null)), 0)"  # every shape begins with a digit


def _date_groups(rows: DataFrame) -> DataFrame:
    """Add ``groups``: dates in several tokens of ``ts``, next to each other and then below each other (LAY6).

    Two parts are no date yet if a year follows them."""
    yearly = r"coalesce(rlike({0}, '^\\d{{2,4}}$') and (cast({0} as int) <= 99 or cast({0} as int) between 1900 and 2100), false)".format
    beside = lambda a, b: f"coalesce(abs(get(ts, i + {b}).top - t.top) <= {TOLERANCE}D and get(ts, i + {b}).x0 - get(ts, i + {a}).x1 <= {GAP}D, false)"
    texts = "transform(array(2, 3, 4), k -> array_join(slice(words, i + 1, k), ' '))"
    rows = computed(rows, words="transform(ts, t -> t.text)")
    starts = f"filter(transform(ts, (t, i) -> if(t.begins and {beside(0, 1)}, struct(i as i, {beside(0, 1)} as a, {beside(1, 2)} as b, {beside(2, 3)} as c, {yearly('get(ts, i + 2).text')} as more, {texts} as texts), null)), s -> s is not null)"
    rows = computed(rows, starts=starts).drop("words")
    read = f"transform(filter(starts, s -> s.a), s -> struct(s.i as i, s.b as b, s.b and s.c as c, s.more as more, transform(s.texts, (x, k) -> case when k = 0 or s.b and (k = 1 or s.c) then {date_text('x')} end) as dates))"
    rows = computed(rows, read=read)
    size = "case when get(s.dates, 0) is not null and not s.more then 2 when s.b and get(s.dates, 1) is not null then 3 when s.c and get(s.dates, 2) is not null then 4 end"
    rows = computed(rows, level=f"filter(transform(read, s -> struct({size} as n, s.i as i, s.dates as dates)), s -> s.n is not null)")
    flat = "transform(level, s -> struct(sequence(s.i, s.i + s.n - 1) as at, get(s.dates, s.n - 2) as value))"
    # below each other: a token above the last one's lower end is passed over, one too far off ends the search
    token = "get(ts, acc.start + k)"
    off = f"{token} is null or abs({token}.c - get(ts, acc.start).c) > {CENTRE}D or {token}.top - get(ts, element_at(acc.at, -1)).bottom > {BELOW}D"
    over = f"{token}.top - get(ts, element_at(acc.at, -1)).bottom < -2"
    joined = f"array_join(transform(concat(acc.at, array(acc.start + k)), j -> get(ts, j).text), ' ')"
    value = f"get(transform(array(struct({date_text(joined)} as v)), r -> if(size(acc.at) = 1 and {yearly('get(ts, acc.start + k + 1).text')}, null, r.v)), 0)"
    step = (
        f"case when acc.done then acc when {token} is null or abs({token}.c - get(ts, acc.start).c) > {CENTRE}D then struct(acc.start as start, acc.at as at, acc.value as value, true as done)"
        f" when {over} then acc when {off} then struct(acc.start as start, acc.at as at, acc.value as value, true as done)"
        f" else get(transform(array({value}), v -> struct(acc.start as start, concat(acc.at, array(acc.start + k)) as at, v as value, v is not null as done)), 0) end"
    )
    start = "struct(i as start, array(i) as at, cast(null as string) as value, false as done)"
    down = f"filter(transform(filter(sequence(0, size(ts) - 1), i -> get(ts, i).begins and exists(ts, w -> w.top > get(ts, i).bottom - 2)), i -> aggregate(array(1, 2, 3), {start}, (acc, k) -> {step})), g -> g.value is not null)"
    rows = computed(rows, upright=f"transform({down}, g -> struct(g.at as at, g.value as value))")
    extent = "struct(g.at as at, g.value as value, (array_min(transform(g.at, j -> get(ts, j).x0)) + array_max(transform(g.at, j -> get(ts, j).x1))) / 2 as c)"
    return computed(rows, groups=f"transform(array_distinct(concat({flat}, upright)), g -> {extent})")


#: What a word may be by itself.
_TESTS = {
    "begins": lambda x: rules.date_start(S, x), "fragment": lambda x: rules.date_fragment(S, x), "date": lambda x: f"{date_text(x)} is not null", "number": lambda x: rules.amount(S, x),
    "id": lambda x: rules.identifier(S, x), "tfr": lambda x: f"upper({x}) = 'TFR'", "ignored": lambda x: f"upper({x}) in {tuple(IGNORED)}",
}


def parsed_rows(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Physical rows (doc_id, page_number, row, tokens) as raw rows, by the ``columns`` (doc_id, role, x0, x1) of their document.

    Values are texts: dates in several words as 'yyyy-mm-dd', others as printed."""
    column = F.struct("x0", "x1", "role", ((F.col("x0") + F.col("x1")) / 2).alias("c"))
    by_doc = columns.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(column)).alias("cols"))
    fields = "'text', t.text, 'i', i, 'x0', t.x0, 'x1', t.x1, 'c', (t.x0 + t.x1) / 2, 'top', t.top, 'bottom', t.bottom"
    tests = ", ".join(f"'{name}', {test('t.text')}" for name, test in _TESTS.items())
    return _parsed(computed(rows, ts=f"transform(tokens, (t, i) -> named_struct({fields}, {tests}))").drop("tokens").join(by_doc, "doc_id"))


def _parsed(found: DataFrame) -> DataFrame:
    """Rows with tested tokens ``ts`` and their document's columns ``cols`` as raw rows."""
    found = _date_groups(found)
    of = lambda roles: f"filter(cols, c -> c.role in {roles})"
    group = "array_min(transform(filter(groups, g -> not arrays_overlap(g.at, acc.taken) and abs(g.c - c.c) <= {r}D), g -> struct(abs(g.c - c.c) as d, array_position(groups, g) as n, g.at as at, g.value as value)))".format(r=DATE_REACH)
    whole = "array_min(transform(filter(ts, t -> t.date and not array_contains(acc.used, t.i)), t -> struct(abs(t.c - c.c) as d, t.i as i, t.text as value)))"
    put = "struct(concat(acc.used, {at}) as used, concat(acc.taken, {taken}) as taken, concat(acc.found, array(struct(c.role as role, {value} as value))) as found)".format
    step = (
        f"get(transform(array(struct({group} as g, {whole} as w)), b -> case when b.g is not null then {put(at='b.g.at', taken='b.g.at', value='b.g.value')}"
        f" when b.w is not null then {put(at='array(b.w.i)', taken='cast(array() as array<int>)', value='b.w.value')} else acc end), 0)"
    )
    none = "struct(cast(array() as array<int>) as used, cast(array() as array<int>) as taken, cast(array() as array<struct<role: string, value: string>>) as found)"
    found = computed(found, dated=f"array(aggregate({of(DATES)}, {none}, (acc, c) -> {step}))")
    near = "array_min(transform(filter(ts, t -> (t.id or t.tfr) and not array_contains(try_element_at(dated, 1).used, t.i)), t -> struct(abs(t.c - id_at) as d, t.i as i))).i"
    found = computed(found, id_at=f"get({of("('transaction_id')")}, 0).c")
    found = computed(found, id_i=f"if(id_at is null, null, {near})")
    found = computed(found, ids="case when id_i is not null then if(get(ts, id_i).tfr and coalesce(get(ts, id_i + 1).id, false), array(id_i, id_i + 1), array(id_i)) end")
    found = computed(found, transaction_id="case when size(ids) = 2 then concat('TFR ', get(ts, id_i + 1).text) else get(ts, id_i).text end", used="concat(try_element_at(dated, 1).used, coalesce(ids, array()))")
    found = computed(found, numbers="filter(ts, t -> t.number and not array_contains(used, t.i))", number_cols=of(NUMBERS))
    inside = f"(t.c >= c.x0 - {INSIDE}D and t.c <= c.x1 + {INSIDE}D)"
    rated = f"abs(t.c - c.c) - if({inside}, {BONUS}D, 0D)"
    free = "filter(numbers, t -> not exists(acc, p -> p.i = t.i))"
    best = f"array_min(transform({free}, t -> struct({rated} as d, t.i as i)))"
    in_turn = f"aggregate(transform(number_cols, (c, k) -> struct(c.role as role, c.x0 as x0, c.x1 as x1, c.c as c, k as k)), cast(array() as array<struct<i: int, k: int>>), (acc, c) -> get(transform(array({best}), b -> if(b is null, acc, concat(acc, array(struct(b.i as i, c.k as k))))), 0))"
    pairs = f"array_sort(flatten(transform(numbers, (t, n) -> filter(transform(number_cols, (c, k) -> if({inside} or abs(t.c - c.c) <= {REACH}D, struct({rated} as d, n as n, k as k, t.i as i), null)), p -> p is not null))))"
    found = computed(found, pairs=pairs)
    greedy = "aggregate(pairs, cast(array() as array<struct<i: int, k: int>>), (acc, p) -> if(exists(acc, o -> o.i = p.i or o.k = p.k), acc, concat(acc, array(struct(p.i as i, p.k as k)))))"
    found = computed(found, placed=f"if(exists(number_cols, c -> c.role in ('debit', 'credit')), {greedy}, {in_turn})")
    last = "get(ts, try_element_at(filter(placed, p -> get(number_cols, p.k).role = '{r}'), -1).i)".format
    found = computed(found, **{f"_{r}": f"array({last(r=r)})" for r in NUMBERS})
    taken = f"concat(used, array_compact(array({', '.join(f'try_element_at(_{r}, 1).i' for r in NUMBERS)})))"
    left = f"array_except(transform(filter(ts, t -> not t.ignored and not t.date and not t.number and not t.fragment and not (transaction_id is not null and (t.id or t.tfr))), t -> t.i), {taken})"
    story = f"if(exists(cols, c -> c.role = 'description'), nullif(array_join(transform({left}, i -> get(ts, i).text), ' '), ''), null)"
    dates = {r: f"try_element_at(filter(try_element_at(dated, 1).found, d -> d.role = '{r}'), -1).value" for r in DATES}
    found = computed(found, **dates, description=story, **{r: f"try_element_at(_{r}, 1).text" for r in NUMBERS})
    return found.select("doc_id", "page_number", "row", *DATES, "description", *NUMBERS, "transaction_id")


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with a date, an amount, and a description or a reference, that are no totals or notes (FLT12)."""
    said = f"lower(concat_ws(' ', {', '.join([*DATES, 'transaction_id', *NUMBERS, 'description'])}))"
    rows = computed(rows, said=said)
    note = " or ".join(f"contains(said, '{t}')" for t in METADATA_TERMS)
    return rows.filter(f"coalesce({', '.join(DATES)}) is not null and coalesce(amount, debit, credit) is not null and coalesce(description, transaction_id) is not null and not ({note})").drop("said")


def with_years(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Dates without a year get the one that stands most often on their page, the first on ties; without any they stay (ETL17-18)."""
    years = words.filter(r"rlike(trim(text), '^(19|20|21)\\d{2}$')").groupBy(F.col("doc_id").cast("string").alias("doc_id"), "page_number", F.trim("text").alias("year"))
    years = years.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("top", "x0")).alias("first"))
    best = years.groupBy("doc_id", "page_number").agg(F.max_by("year", F.struct("n", -F.col("first.top"), -F.col("first.x0"))).alias("year"))
    out = rows.join(best, ["doc_id", "page_number"], "left")
    for r in DATES:
        out = out.withColumn(r, F.expr(f"if(startswith({r}, '0001-') and year is not null, concat(year, substring({r}, 5)), {r})"))
    return out.drop("year")


def generic_rows(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Transactions of positioned words below their document's header, by its columns (doc_id, role, x0, x1, top) (LAY3).

    Rows go by the first word's top; a document without columns gives none."""
    tests = {name: test("text") for name, test in _TESTS.items()}
    rows = _parsed(document_rows(words, columns, tests, ["text", "i", "x0", "x1", "c", "top", "bottom"], TOLERANCE, running_mean=False, below=HEADER))
    return with_years(valid_rows(rows), words)
