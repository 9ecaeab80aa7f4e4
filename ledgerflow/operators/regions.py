"""Rows of positioned words, each number in the column that the order of both allows (LAY18-24, HLP2, HLP5, FLT14).

Words of a page stream by once, from top to bottom, and leave as physical rows; a row is then parsed by itself, in
expressions over its tokens.  Numbers and columns are matched in their order from left to right at the least total
distance, by a fold that keeps the best partial assignment for each number of columns filled: a row with debit and balance
only does not push the balance into the credit column because that is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import tokens as rules
from ledgerflow.functions.columns import computed
from ledgerflow.functions.dialect import SPARK as S

DATES = ("transaction_date", "posting_date", "value_date")
NUMBERS = ("amount", "debit", "credit", "balance")
# Words that stand next to a reference, and words that belong to no description.
MARKERS = ["TFR", "TRF", "TXN", "TRAN", "TRANSFER", "REF", "REFERENCE"]
IGNORED = ["DR", "CR"]
#: A number farther than this from a column's centre is not its value.
FARTHEST = 150.0
_TOKEN = ["text", "x0", "x1", "top", "bottom"]
_ROWS = "doc_id string, page_number int, row int, tokens array<struct<text string, x0 double, x1 double, top double, bottom double>>"


def _starts(docs: list, pages: list, tops: list[float], number: int | None, tolerance: float, running_mean: bool) -> tuple[list[int], list[int]]:
    """Where rows begin among words, and the rows' numbers on their pages; the first row goes on with ``number``."""
    starts, numbers, key, total, n, anchor = [], [], None, 0.0, 0, 0.0
    for i, top in enumerate(tops):
        if (docs[i], pages[i]) != key:
            numbers.append(0 if starts or number is None else number)
            key, same = (docs[i], pages[i]), False
        else:
            same = abs(top - (total / n if running_mean else anchor)) <= tolerance
            if not same:
                numbers.append(numbers[-1] + 1)
        if same:
            total, n = total + top, n + 1
        else:
            starts.append(i)
            total, n, anchor = top, 1, top
    return starts, numbers


def _rows_of(batches: Iterator[pa.RecordBatch], tolerance: float, running_mean: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a stream sorted by page and top.  Only the row at hand is kept from one batch to the next."""
    held, number = None, 0
    columns = ["doc_id", "page_number", *_TOKEN]

    def made(words: pa.Table, starts: list[int], numbers: list[int]) -> pa.RecordBatch:
        sizes = np.diff([*starts, words.num_rows])
        row = np.repeat(np.arange(len(starts)), sizes)
        order = pa.array(np.lexsort((words.column("top").to_numpy(), words.column("x0").to_numpy(), row)))
        words = words.combine_chunks()
        token = pa.StructArray.from_arrays([words.column(c).take(order).combine_chunks() for c in _TOKEN], _TOKEN)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), token)
        first = pa.array(starts)
        keys = [words.column(c).take(first).combine_chunks() for c in columns[:2]]
        return pa.RecordBatch.from_arrays([*keys, pa.array(numbers, pa.int32()), lists], ["doc_id", "page_number", "row", "tokens"])

    for batch in batches:
        if not batch.num_rows:
            continue
        words = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        starts, numbers = _starts(*(words.column(c).to_pylist() for c in ("doc_id", "page_number", "top")), None if held is None else number, tolerance, running_mean)
        if len(starts) > 1:
            yield made(words.slice(0, starts[-1]), starts[:-1], numbers[:-1])
        held, number = words.slice(starts[-1]), numbers[-1]
    if held is not None:
        yield made(held, [0], [number])


def placed_words(words: DataFrame) -> DataFrame:
    """Words with a text and a place; a missing right or lower end is the other one."""
    return words.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"), F.col("x0").cast("double").alias("x0"),
        F.coalesce("x1", "x0").cast("double").alias("x1"), F.col("top").cast("double").alias("top"), F.coalesce("bottom", "top").cast("double").alias("bottom"),
    ).filter("text <> '' and x0 is not null and top is not null")


def physical_rows(words: DataFrame, tolerance: float = 4.0, running_mean: bool = True) -> DataFrame:
    """The physical rows of each page of ``words`` (doc_id, page_number, text, x0, x1, top, bottom): row and its tokens from left to right.

    From top to bottom a word joins the row at hand if it lies within ``tolerance`` of the mean of the row's words, or of its
    first word.  Blank words and those without a place are left out; a missing right or lower end is the other one.  The
    only shuffle is by page; a page may have any number of words.
    """
    ordered = placed_words(words).repartition("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", "top", "x0", "x1", "text")
    return ordered.mapInArrow(lambda b: _rows_of(b, tolerance, running_mean), _ROWS)


def _document_rows_of(batches: Iterator[pa.RecordBatch], tolerance: float, running_mean: bool, fields: list[str], tests: list[str]) -> Iterator[pa.RecordBatch]:
    """Physical rows of a stream in which a document's columns stand before its words, with the columns.

    Kept from one batch to the next are the row at hand, the columns of its document, and the columns read last."""
    plain = ["doc_id", "page_number", *_TOKEN, "kind"]
    names = [*fields, *tests]
    held, number, last = None, 0, None

    def made(words: pa.Table, at: np.ndarray, pool: pa.Array, starts: list[int], numbers: list[int]) -> pa.RecordBatch:
        words = words.combine_chunks()
        sizes = np.diff([*starts, words.num_rows])
        row, x0, x1 = np.repeat(np.arange(len(starts)), sizes), words.column("x0").to_numpy(), words.column("x1").to_numpy()
        order = np.lexsort((words.column("top").to_numpy(), x0, row))
        of, place = pa.array(order), np.arange(len(order)) - np.repeat(np.asarray(starts), sizes)
        own = {"i": pa.array(place, pa.int32()), "c": pa.array(((x0 + x1) / 2)[order])}
        kind = words.column("kind").to_numpy()[order]
        token = [own[f] if f in own else words.column(f).take(of).combine_chunks() for f in fields] + [pa.array(kind & (1 << n) != 0) for n in range(len(tests))]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(token, names))
        keys = [words.column(c).take(pa.array(starts)).combine_chunks() for c in plain[:2]]
        return pa.RecordBatch.from_arrays([*keys, pa.array(numbers, pa.int32()), lists, pool.take(pa.array(at[starts]))], ["doc_id", "page_number", "row", "ts", "cols"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # the columns of the row at hand, those read last, those of this batch
        word = batch.column("word").to_numpy(zero_copy_only=False)
        heads = batch.filter(pa.array(~word))
        before = [x for x in (None if held is None else held[1], last) if x is not None]
        pool = pa.Table.from_batches([*before, heads.select(["doc_id", "top", "cols"])]).combine_chunks()
        at = (len(before) - 1 + np.cumsum(~word))[word]
        words = pa.Table.from_batches([batch.filter(pa.array(word)).select(plain)])
        if pool.num_rows:
            last = pool.slice(pool.num_rows - 1).to_batches()[0]
            mine = np.maximum(at, 0)
            floor, top = pool.column("top").to_numpy()[mine], words.column("top").to_numpy()
            same = pc.equal(pool.column("doc_id").take(pa.array(mine)), words.column("doc_id")).to_numpy(zero_copy_only=False)
            stays = (at >= (0 if held is None else 1)) & same & ~(top <= floor) & ~np.isnan(floor)
        else:
            stays = np.zeros(len(at), bool)
        words, at = words.filter(pa.array(stays)), at[stays]
        if not words.num_rows:
            continue
        if held is not None:
            words, at = pa.concat_tables([held[0], words]), np.concatenate([np.zeros(held[0].num_rows, np.int64), at])
        lists = pool.column("cols").combine_chunks()
        starts, numbers = _starts(*(words.column(c).to_pylist() for c in ("doc_id", "page_number", "top")), None if held is None else number, tolerance, running_mean)
        if len(starts) > 1:
            yield made(words.slice(0, starts[-1]), at[: starts[-1]], lists, starts[:-1], numbers[:-1])
        held, number = (words.slice(starts[-1]), pool.slice(int(at[-1]), 1).to_batches()[0]), numbers[-1]
    if held is not None:
        yield made(held[0], np.zeros(held[0].num_rows, np.int64), held[1].column("cols"), [0], [number])


def document_rows(words: DataFrame, columns: DataFrame, tests: dict[str, str], fields: list[str], tolerance: float = 4.0, running_mean: bool = True, below: float | None = None) -> DataFrame:
    """Physical rows (as ``physical_rows``) of the documents that have ``columns`` (doc_id, role, x0, x1), with them: doc_id, page_number, row, ts, cols.

    ``ts`` are the tokens from left to right with ``fields`` (of text, i, c, x0, x1, top, bottom) and one boolean for each of
    ``tests``, expressions over ``text``.  Words are tested where they stand alone, before they meet as rows.  The only
    shuffle is by document, of words and columns together: columns come first in it, so rows need not be joined with them.
    ``below``: words must lie lower than the lowest top of the columns by more than this."""
    column = F.struct(F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "role", ((F.col("x0") + F.col("x1")) / 2).cast("double").alias("c"))
    floor = F.lit(float("-inf")) if below is None else F.max("top") + below
    heads = columns.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(column)).alias("cols"), floor.cast("double").alias("top"))
    kind = " + ".join(f"if({test}, {1 << n}, 0)" for n, test in enumerate(tests.values()))
    placed = placed_words(words).filter("doc_id is not null").withColumn("kind", F.expr(kind)).withColumn("word", F.lit(True))
    both = placed.unionByName(heads.filter("doc_id is not null and top is not null").withColumn("word", F.lit(False)), allowMissingColumns=True)
    ordered = both.repartition("doc_id").sortWithinPartitions("doc_id", "word", "page_number", "top", "x0", "x1", "text")
    kinds = {"text": "string", "i": "int"}
    token = ", ".join([f"{f}: {kinds.get(f, 'double')}" for f in fields] + [f"{t}: boolean" for t in tests])
    schema = f"doc_id string, page_number int, row int, ts array<struct<{token}>>, cols array<struct<x0: double, x1: double, role: string, c: double>>"
    names = list(tests)
    return ordered.mapInArrow(lambda b: _document_rows_of(b, tolerance, running_mean, fields, names), schema)


def ordered_assignment(values: str, columns: str, limit: float | None = None) -> Column:
    """Pairs (v, k) of places in ``values`` and ``columns``, two arrays of structs with a centre ``c``, sorted by it.

    All of the shorter array are matched, in order, at the least total distance; of equal totals the choice with the
    leftmost places wins.  No pair is farther apart than ``limit``; without such a choice, or with nothing to match, null."""

    def choice(longer: str, shorter: str) -> str:
        apart = f"abs(a.c - get({shorter}, j - 1).c)"
        within = f"{apart} <= {limit}" if limit is not None else "true"
        used = f"case when get(acc, j - 1) is not null and {within} then named_struct('cost', get(acc, j - 1).cost + {apart}, 'path', concat(get(acc, j - 1).path, array(a.i))) end"
        none = "cast(null as struct<cost: double, path: array<int>>)"
        start = f"concat(array(named_struct('cost', cast(0 as double), 'path', cast(array() as array<int>))), array_repeat({none}, size({shorter})))"
        numbered = f"transform({longer}, (x, i) -> named_struct('c', x.c, 'i', i))"
        return f"aggregate({numbered}, {start}, (acc, a) -> transform(acc, (s, j) -> if(j = 0, s, least(s, {used}))), acc -> get(acc, size({shorter})).path)"

    pair = "named_struct('v', {}, 'k', {})"
    few = f"transform({choice(columns, values)}, (p, i) -> {pair.format('i', 'p')})"
    many = f"transform({choice(values, columns)}, (p, i) -> {pair.format('p', 'i')})"
    # as many columns as values leave one choice
    fits = f"size(filter({values}, (a, i) -> coalesce(abs(a.c - get({columns}, i).c) > {limit}, true))) = 0" if limit is not None else "true"
    same = f"if({fits}, transform({values}, (a, i) -> {pair.format('i', 'i')}), null)"
    return F.expr(f"case when size({values}) = 0 or size({columns}) = 0 then null when size({values}) = size({columns}) then {same} when size({values}) <= size({columns}) then {few} else {many} end")


def _number(text: str) -> str:
    """The value of a number's text: brackets make it negative, CR and DR go (HLP7)."""
    bare = f"trim(regexp_replace(replace(replace({text}, ',', ''), '\\u00a0', ''), '(?i)(CR|DR)$', ''))"
    value = f"try_cast(trim(BOTH '()' FROM {bare}) as double)"
    return f"case when startswith({bare}, '(') and endswith({bare}, ')') then -{value} else {value} end"


_MONTH = f"trim(TRAILING '.' FROM upper(text)) in ({', '.join(repr(m.upper()) for m in rules.SHORT_MONTHS)})"
#: What a word may be by itself.
_TESTS = {"full": rules.full_date(S, "text"), "day": rules.day(S, "text"), "month": _MONTH, "number": rules.number(S, "text"), "reference": rules.reference(S, "text"), "ignored": f"upper(text) in {tuple(IGNORED)}"}


def parsed_rows(found: DataFrame) -> DataFrame:
    """Each physical row with a date as a raw row, by its document's columns (``document_rows``, tested by ``_TESTS``).

    A date is one word, or a day with a month after it.  Dates go to date columns in order.  A number that is no part of
    a date goes to the column that ``ordered_assignment`` finds; the reference nearest to its column takes a marker next
    to it along; what is left is the description.  Where two columns have one role, the right one counts."""
    after, before = "coalesce(get(ts, t.i + 1).month, false)", "coalesce(get(ts, t.i - 1).month, false)"
    by_centre = "(a, b) -> case when a.c < b.c then -1 when a.c > b.c then 1 else 0 end"
    split = f"named_struct('c', (t.c + get(ts, t.i + 1).c) / 2, 'text', concat(t.text, ' ', trim(TRAILING '.' FROM upper(get(ts, t.i + 1).text))), 'at', array(t.i, t.i + 1))"
    date = f"case when t.full then named_struct('c', t.c, 'text', t.text, 'at', array(t.i)) when t.day and {after} then {split} end"
    found = computed(found, dates=f"array_sort(filter(transform(ts, t -> {date}), d -> d is not null), {by_centre})")
    found = found.filter("size(dates) > 0")
    # places are told apart by sets, once for a row
    free = f"array_except(transform(filter(ts, t -> t.number and not (t.day and ({after} or {before}))), t -> t.i), flatten(transform(dates, d -> d.at)))"
    of_roles = lambda roles: f"array_sort(filter(cols, c -> c.role in {roles}), {by_centre})"
    found = computed(found, numbers=f"array_sort(transform({free}, i -> get(ts, i)), {by_centre})", number_cols=of_roles(NUMBERS), date_cols=of_roles(DATES))
    in_turn = F.expr("transform(slice(dates, 1, least(size(dates), size(date_cols))), (d, i) -> named_struct('v', i, 'k', i))")
    date_pairs = F.when(F.expr("size(dates) > size(date_cols)"), ordered_assignment("dates", "date_cols")).otherwise(in_turn)
    found = computed(found, pairs=ordered_assignment("numbers", "number_cols", FARTHEST), date_pairs=date_pairs)
    last = lambda pairs, cols, role: f"try_element_at(filter({pairs}, p -> get({cols}, p.k).role = '{role}'), -1)"
    values = {f"_{role}": f"array(get(numbers, {last('pairs', 'number_cols', role)}.v))" for role in NUMBERS}
    found = computed(found, **values, **{role: f"get(dates, {last('date_pairs', 'date_cols', role)}.v).text" for role in DATES})
    used = f"concat(flatten(transform(dates, d -> d.at)), array_compact(array({', '.join(f'try_element_at(_{r}, 1).i' for r in NUMBERS)})))"
    found = computed(found, used=used, id_at="array_min(transform(filter(cols, c -> c.role = 'transaction_id'), c -> c.c))")
    references = f"filter(ts, t -> t.reference and not array_contains(used, t.i))"
    found = computed(found, id_i=f"case when id_at is not null then array_min(transform({references}, t -> named_struct('d', abs(t.c - id_at), 'i', t.i))).i end")
    marker = lambda at: f"coalesce({at} >= 0 and not array_contains(used, {at}) and upper(get(ts, {at}).text) in {tuple(MARKERS)}, false)"
    ids = f"case when {marker('id_i - 1')} then array(id_i - 1, id_i) when {marker('id_i + 1')} then array(id_i, id_i + 1) when id_i is not null then array(id_i) end"
    found = computed(found, ids=ids)
    left = "array_except(transform(filter(ts, t -> not t.ignored), t -> t.i), concat(used, coalesce(ids, array())))"
    filled = f"size(filter(date_cols, c -> case c.role {' '.join(f'when {d!r} then {d} is not null' for d in DATES)} end))"
    found = computed(
        found,
        description=f"nullif(array_join(transform({left}, i -> get(ts, i).text), ' '), '')",
        transaction_id="array_join(transform(ids, i -> get(ts, i).text), ' ')",
        filled=filled,
        date_columns="size(date_cols)",
        **{r: _number(f"try_element_at(_{r}, 1).text") for r in NUMBERS},
    )
    return found.select("doc_id", "page_number", "row", *DATES, "description", *NUMBERS, "transaction_id", "filled", "date_columns")


def valid_rows(rows: DataFrame) -> DataFrame:
    """Parsed rows that are transactions: a date, every date column filled where there are two or more, an amount, a description (FLT14)."""
    dated = F.expr("filled > 0 and (date_columns < 2 or filled = date_columns)")
    return rows.filter(dated & F.expr("coalesce(amount, debit, credit) is not null and description is not null")).drop("filled", "date_columns")


def ordered_rows(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Transactions of positioned words, by the columns of each document; a document without columns gives none."""
    return valid_rows(parsed_rows(document_rows(words, columns, _TESTS, ["text", "i", "c"])))
