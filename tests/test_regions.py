"""Rows with ordered assignment against plain enumeration of all choices."""

import itertools
import random
import re

from ledgerflow.operators.regions import FARTHEST, MARKERS, ordered_rows, physical_rows

WORDS = "doc_id string, page_number int, text string, x0 double, x1 double, top double, bottom double"
COLUMNS = "doc_id string, role string, x0 double, x1 double"
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
FULL = re.compile(r"(\d{1,2}[-/][A-Za-z]{3}[-/]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}\.\d{1,2}\.\d{2,4})$")
NUMBER = re.compile(r"[(\-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?(CR|DR)?\)?$", re.I)
REFERENCE = re.compile(r"([A-Z]\d{5,}|[A-Z]{1,4}\d{4,}|\d{6,}|[A-Z0-9]{6,}/[A-Z0-9/_-]+)$", re.I)


def cheapest(values, columns, limit=float("inf")):
    """All choices, one by one: [(value, column)] of least total distance, the first on ties."""
    if not values or not columns:
        return []
    few = len(values) <= len(columns)
    best, least = [], float("inf")
    for chosen in itertools.combinations(columns if few else values, len(values) if few else len(columns)):
        pairs = list(zip(values, chosen) if few else zip(chosen, columns))
        apart = [abs(v["c"] - c["c"]) for v, c in pairs]
        if max(apart) <= limit and sum(apart) < least:
            best, least = pairs, sum(apart)
    return best


def value_of(text):
    bare = re.sub(r"(CR|DR)$", "", text.replace(",", ""), flags=re.I).strip()
    try:
        return -float(bare.strip("()")) if bare[0] == "(" and bare[-1] == ")" else float(bare.strip("()"))
    except ValueError:
        return None


def parsed(tokens, columns):
    tokens = sorted(({"text": t, "c": (a + b) / 2, "x0": a} for t, a, b in tokens), key=lambda t: t["x0"])
    columns = sorted(({"role": r, "c": (a + b) / 2, "x": (a, b)} for r, a, b in columns), key=lambda c: (c["x"], c["role"]))
    month = lambda i: 0 <= i < len(tokens) and tokens[i]["text"].upper().rstrip(".") in MONTHS
    day = lambda i: bool(re.fullmatch(r"\d{1,2}", tokens[i]["text"])) and 1 <= int(tokens[i]["text"]) <= 31
    dates, used = [], set()
    for i, t in enumerate(tokens):
        if FULL.match(t["text"]):
            dates.append({"c": t["c"], "text": t["text"]})
            used.add(i)
        elif day(i) and month(i + 1):
            dates.append({"c": (t["c"] + tokens[i + 1]["c"]) / 2, "text": t["text"] + " " + tokens[i + 1]["text"].upper().rstrip(".")})
            used |= {i, i + 1}
    if not dates:
        return None
    dates.sort(key=lambda d: d["c"])
    out = {}
    dated = sorted((c for c in columns if c["role"].endswith("date")), key=lambda c: c["c"])
    for d, c in cheapest(dates, dated) if len(dates) > len(dated) else zip(dates, dated):
        out[c["role"]] = d["text"]
    numbers = [{**t, "i": i} for i, t in enumerate(tokens) if i not in used and NUMBER.match(t["text"]) and not (day(i) and (month(i + 1) or month(i - 1)))]
    numeric = sorted((c for c in columns if c["role"] in ("amount", "debit", "credit", "balance")), key=lambda c: c["c"])
    placed = {c["role"]: v for v, c in cheapest(sorted(numbers, key=lambda v: v["c"]), numeric, FARTHEST)}
    used |= {v["i"] for v in placed.values()}
    out |= {r: value_of(v["text"]) for r, v in placed.items()}
    at = [c["c"] for c in columns if c["role"] == "transaction_id"]
    ids = [(abs(t["c"] - min(at)), i) for i, t in enumerate(tokens) if at and i not in used and REFERENCE.match(t["text"])]
    if ids:
        i = min(ids)[1]
        beside = next((j for j in (i - 1, i + 1) if 0 <= j < len(tokens) and j not in used and tokens[j]["text"].upper() in MARKERS), None)
        taken = sorted({i} | ({beside} if beside is not None else set()))
        used |= set(taken)
        out["transaction_id"] = " ".join(tokens[j]["text"] for j in taken)
    out["description"] = " ".join(t["text"] for i, t in enumerate(tokens) if i not in used and t["text"].upper() not in ("DR", "CR"))
    filled = [c for c in dated if out.get(c["role"])]
    money = any(out.get(r) is not None for r in ("amount", "debit", "credit"))
    return out if filled and money and out["description"] and (len(dated) < 2 or len(filled) == len(dated)) else None


FIELDS = ["transaction_date", "posting_date", "value_date", "description", "amount", "debit", "credit", "balance", "transaction_id"]


def test_against_enumeration(spark):
    rnd = random.Random(4)
    pool = ["01/02/2024", "5-Mar-24", "2024-03-01", "7", "12", "Aug", "JAN.", "may", "260.00", "2,845.15", "(3.50)", "10.00CR", "-4", "S63313909", "AB1234", "TFR", "ref", "ORDER", "Shop", "DR", "123456", "x"]
    roles = ["transaction_date", "value_date", "posting_date", "description", "amount", "debit", "credit", "balance", "transaction_id", "debit"]
    words, columns, want = [], [], {}
    for n in range(400):
        doc = f"d{n}"
        cols = [(r, float(x), float(x + rnd.choice([30, 40]))) for r in rnd.sample(roles, rnd.randrange(1, 9)) for x in [rnd.randrange(0, 500, 20)]]
        tokens = [(rnd.choice(pool), float(x), float(x + 20)) for x in rnd.sample(range(0, 600, 7), rnd.randrange(1, 14))]
        columns += [(doc, *c) for c in cols]
        words += [(doc, 1, f" {t} ", a, b, 50 + rnd.choice([0.0, 1.0, 2.0]), None) for t, a, b in tokens]
        found = parsed(tokens, cols)
        if found:
            want[doc] = tuple(found.get(f) for f in FIELDS)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in ordered_rows(spark.createDataFrame(words, WORDS), spark.createDataFrame(columns, COLUMNS)).collect()}
    assert got == want and len(want) > 50


def test_two_values_three_columns(spark):
    """260.00 and 2,845.15 under withdrawals, deposits and balance: the second is nearer to deposits, yet belongs to balance."""
    columns = [("d", r, x, x + 40.0) for r, x in (("transaction_date", 0.0), ("description", 60.0), ("debit", 200.0), ("credit", 290.0), ("balance", 380.0))]
    for shift, roles in ((0.0, ("debit", "balance")), (-50.0, ("debit", "credit"))):
        words = [("d", 1, t, x, x + 40.0, 10.0, 18.0) for t, x in (("01/02/2024", 0.0), ("Shop", 60.0), ("260.00", 190.0), ("2,845.15", 340.0 + shift))]
        row = ordered_rows(spark.createDataFrame(words, WORDS), spark.createDataFrame(columns, COLUMNS)).collect()[0]
        assert [r for r in ("debit", "credit", "balance") if row[r] is not None] == list(roles)
    far = [("d", 1, t, x, x + 40.0, 10.0, 18.0) for t, x in (("01/02/2024", 0.0), ("Shop", 60.0), ("260.00", 600.0))]
    assert ordered_rows(spark.createDataFrame(far, WORDS), spark.createDataFrame(columns, COLUMNS)).count() == 0


def test_many_numbers_in_a_row_and_long_pages(spark):
    words = [("d", 1, str(100 + i), 200.0 + i / 10, 200.0 + i / 10, 10.0, 18.0) for i in range(300)] + [("d", 1, "01/02/2024", 0.0, 40.0, 10.0, 18.0)]
    words += [("d", 2, "w", float(i % 5), float(i % 5), float(i // 5 * 10), None) for i in range(30_000)]
    columns = [("d", r, x, x) for r, x in (("transaction_date", 20.0), ("debit", 205.0), ("balance", 229.0))]
    frame = spark.createDataFrame(words, WORDS).repartition(3)
    row = ordered_rows(frame, spark.createDataFrame(columns, COLUMNS)).collect()
    assert [(r.debit, r.balance) for r in row] == [(150.0, 390.0)]
    rows = physical_rows(frame).filter("page_number = 2").selectExpr("row", "size(tokens) as n").collect()
    assert sorted((r.row, r.n) for r in rows) == [(i, 5) for i in range(6000)]


def test_running_mean_and_edges(spark):
    words = [("d", 1, t, float(i), None, top, None) for i, (t, top) in enumerate([("a", 0.0), ("b", 3.0), ("c", 5.0), ("d", 8.9)])]
    words += [("d", 1, "  ", 0.0, 0.0, 0.0, 0.0), ("d", 1, None, 0.0, 0.0, 0.0, 0.0), ("d", 1, "x", None, 0.0, 0.0, 0.0), (None, None, "y", 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(words, WORDS)
    texts = lambda **o: sorted([t.text for t in r.tokens] for r in physical_rows(frame, **o).collect() if r.doc_id)
    assert texts() == [["a", "b", "c"], ["d"]]  # 5 lies 3.5 from the mean of 0 and 3
    assert texts(running_mean=False) == [["a", "b"], ["c", "d"]]
    assert physical_rows(frame.limit(0)).count() == 0
    assert ordered_rows(frame, spark.createDataFrame([], COLUMNS)).count() == 0
