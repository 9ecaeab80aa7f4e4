"""Scanned rows and their balances against plain loops."""

import random
import re
from decimal import Decimal

from ledgerflow.operators import scanned

ROWS = "doc_id string, page_number int, position long, description string, amount decimal(18,2), debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)"
WORDS = "doc_id string, page_number int, text string, x0 double, x1 double, top double, bottom double, block int, paragraph int, line int"
CREDITED = ["SALARY", "CREDIT", "DEPOSIT", "RECEIVED", "REFUND", "REVERSAL", "CASHBACK", "CASH BACK", "CBK", "INTEREST"]
DEBITED = ["DEBIT", "ATM", "FEE", "CHARGE", "WITHDRAWAL", "PURCHASE", "PAYMENT TO", "PAYMENT FOR", "TRANSFER TO"]
FIELDS = ("amount", "debit", "credit", "balance")


def worded(row):
    text = re.sub("[^A-Z0-9]+", " ", (row["description"] or "").upper())
    if any(t in text for t in CREDITED):
        return "credit"
    return "debit" if "PAYMENT RECEIVED" not in text and any(t in text for t in DEBITED) else None


def carry(rows):
    last = None
    for r in rows:
        moved = -r["debit"] if r["debit"] is not None else r["credit"]
        if last is None:
            if not any(r[f] for f in ("debit", "credit", "amount")) and r["balance"] is not None and worded(r) == "credit":
                r["credit"] = r["balance"]
        elif moved is not None:
            if r["balance"] is None or abs(r["balance"] - last - moved) > 1:
                r["balance"] = last + moved
        elif r["balance"] is not None:
            if r["balance"] != last:
                r["debit" if r["balance"] < last else "credit"] = abs(r["balance"] - last)
        elif r["amount"] is not None and worded(r):
            r[worded(r)], r["amount"] = r["amount"], None
        last = r["balance"] if r["balance"] is not None else last


def reconcile(rows):
    before = None
    for r in rows:
        if before is not None and r["balance"] is not None:
            shift = r["balance"] - before
            side = "debit" if shift < 0 else "credit"
            if r["debit"] is not None:
                if abs(before - r["debit"] - r["balance"]) > 1:
                    r["debit"] = None
                    if shift:
                        r[side] = abs(shift)
            elif r["credit"] is not None:
                if abs(before + r["credit"] - r["balance"]) > 1:
                    r["credit"] = None
                    if shift:
                        r[side] = abs(shift)
            elif shift:
                r[side] = abs(shift)
            if r["debit"] is not None or r["credit"] is not None:
                r["amount"] = None
        elif before is not None:
            if r["debit"] is None and r["credit"] is None and r["amount"] is not None and worded(r):
                r[worded(r)], r["amount"] = r["amount"], None
            if r["debit"] is not None or r["credit"] is not None:
                r["balance"] = before - r["debit"] if r["debit"] is not None else before + r["credit"]
        before = r["balance"]
    if rows and rows[0]["debit"] is None and rows[0]["credit"] is None and rows[0]["balance"] is not None and worded(rows[0]) == "credit":
        rows[0]["credit"] = rows[0]["balance"]


def random_pages(seed, n):
    rnd = random.Random(seed)
    pages = {}
    for p in range(n):
        rows, balance = [], Decimal(500)
        for k in range(rnd.randrange(1, 14)):
            move = Decimal(rnd.choice(["5.00", "12.50", "0.00", "100.00", "-7.25", "-80.00"]))
            balance += move
            row = dict.fromkeys(FIELDS) | {"position": k, "description": rnd.choice(["SALARY JAN", "ATM 5", "shop", None, "PAYMENT RECEIVED FOR FEE", "card fee"])}
            if rnd.random() < 0.5:
                row["credit" if move >= 0 else "debit"] = abs(move) + rnd.choice([0, 0, 0, 1, 40])
            if rnd.random() < 0.1:
                row["credit"] = Decimal("3.00")
            if rnd.random() < 0.3:
                row["amount"] = abs(move)
            if rnd.random() < 0.5:
                row["balance"] = balance + rnd.choice([0, 0, 0, 1, 30])
            rows.append(row)
        pages[f"d{p // 2}", p % 2 + 1] = rows
    return pages


def as_frame(spark, pages):
    data = [(*key, r["position"], r["description"], *(r[f] for f in FIELDS)) for key, rows in pages.items() for r in rows]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, ROWS)


def found(frame):
    return {(r.doc_id, r.page_number, r.position): tuple(r[f] for f in FIELDS) for r in frame.collect()}


def test_balances_against_plain_loops(spark):
    for run, plain in ((scanned.carry_balances, [carry]), (scanned.reconcile_rows, [reconcile]), (lambda f: scanned.reconcile_rows(scanned.carry_balances(f)), [carry, reconcile])):
        pages = random_pages(3, 300)
        frame = as_frame(spark, pages)
        for step in plain:
            for rows in pages.values():
                step(rows)
        want = {(*key, r["position"]): tuple(r[f] for f in FIELDS) for key, rows in pages.items() for r in rows}
        got = found(run(frame))
        wrong = [(k, got[k], want[k]) for k in want if got[k] != want[k]]
        assert not wrong, wrong[:3]
        assert run(frame.limit(0)).count() == 0


def test_a_corrected_row_is_the_base_of_the_next(spark):
    """100, then -10 read as 900: the balance becomes 90, and -5 leads to 85 although 895 is printed."""
    rows = [dict.fromkeys(FIELDS) | {"position": i, "description": "x"} for i in range(3)]
    rows[0] |= {"balance": Decimal(100)}
    rows[1] |= {"debit": Decimal(10), "balance": Decimal(900)}
    rows[2] |= {"debit": Decimal(5), "balance": Decimal(895)}
    got = found(scanned.carry_balances(as_frame(spark, {("d", 1): rows})))
    assert [got["d", 1, i][3] for i in range(3)] == [100, 90, 85]


DATE = re.compile(r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/][A-Za-z]{3,9}[-/]\d{2,4})$")
NUMBER = re.compile(r"-?\d[\d,]*(\.\d+)?$")


def plain_rows(primary, numbers):
    date = lambda t: t.strip().strip("|,[]*\\(){}")
    bare = lambda t: t.strip().strip("|[]*\\(){};:").replace("$", "").strip()
    plain = lambda t: re.sub(" +", " ", re.sub("[^a-z ]", " ", t.lower())).strip()
    role = {a: r for r, names in scanned.ALIASES.items() for a in names}
    by_line = {}
    for w in primary:
        by_line.setdefault(w["line"], []).append(w)
    lines = sorted((min(w["top"] for w in ws), n, sorted(ws, key=lambda w: w["x0"])) for n, ws in by_line.items())
    first = next((i for i, (_, _, ws) in enumerate(lines) if DATE.match(date(ws[0]["text"]))), None)
    if first is None:
        return []
    best = (2, 0, None)
    for n, (_, _, ws) in enumerate(lines[max(0, first - 15) : first]):
        cols = {role[plain(w["text"])]: (w["x0"] + w["x1"]) / 2 for w in ws if plain(w["text"]) in role}
        for i in range(len(ws)):
            for k in (2, 3):
                text = " ".join(plain(w["text"]) for w in ws[i : i + k]).strip()
                if i + k <= len(ws) and text in role:
                    cols[role[text]] = (ws[i]["x0"] + ws[i + k - 1]["x1"]) / 2
        if len(cols) >= 3:
            best = max(best, (len(cols), n, cols), key=lambda b: b[:2])
    cols = best[2]
    tops = []
    for t in sorted(w["top"] for w in primary if DATE.match(date(w["text"])) and w["top"] >= 200):
        if not tops or t - tops[-1] > 18:
            tops.append(t)
    tops = [t for i, t in enumerate(tops) if (i and t - tops[i - 1] <= 250) or (i + 1 < len(tops) and tops[i + 1] - t <= 250)]
    out = []
    for n, t in enumerate(tops if cols else []):
        low, high = (tops[n - 1] + t) / 2 if n else t - 30, (t + tops[n + 1]) / 2 if n + 1 < len(tops) else t + 130
        mine = [w for w in primary if low <= w["top"] < high]
        money = [cols[r] for r in scanned.MONEY if r in cols]
        near = lambda c, money=money: any(abs(c - m) <= 125 for m in money)
        items = []
        for w in mine + [w for w in numbers if low <= w["top"] < high]:
            text, c = bare(w["text"]), (w["x0"] + w["x1"]) / 2
            if NUMBER.match(text) and not re.fullmatch(r"(19|20|21)\d{2}|\d{6,}", text) and (not re.fullmatch(r"\d{1,4}", text) or text == "0" or near(c)):
                items.append({"text": text, "value": float(text.replace(",", "")), "c": c, "top": w["top"]})
        exact = [i for i in items if "." in i["text"] and near(i["c"])]
        items = [i for i in items if "." in i["text"] or not any(abs(i["top"] - e["top"]) <= 8 and abs(i["c"] - e["c"]) <= 100 for e in exact)]
        kept = []
        for i in sorted(items, key=lambda i: (i["top"], i["c"])):
            if not any(abs(i["c"] - e["c"]) < 8 and i["value"] == e["value"] and abs(i["top"] - e["top"]) < 12 for e in kept):
                kept.append(i)
        row, used = {}, set()
        for d, i, r in sorted((abs(k["c"] - cols[r]), i, r) for i, k in enumerate(kept) for r in scanned.MONEY if r in cols):
            if i not in used and r not in row and d <= 125 and (r == "balance" or kept[i]["value"] != 0):
                row[r] = kept[i]["text"]
                used.add(i)
        if "balance" not in row and kept and "balance" in cols:
            right = max(kept, key=lambda k: k["c"])
            if abs(right["c"] - cols["balance"]) <= 125:
                row["balance"] = right["text"]
        words = [w["text"].strip() for w in sorted(mine, key=lambda w: (w["top"], w["x0"]))]
        words = [w.strip("|[]{}") for w in words if w and not DATE.match(date(w)) and not (NUMBER.match(bare(w)) and bare(w)[0] != "-") and w not in ("DR", "CR")]
        story = re.sub(r"\s+", " ", " ".join(w for w in words if w and not re.fullmatch(r"\d{6,}", w))).strip()
        dates = [date(w["text"]) for w in sorted(mine, key=lambda w: w["x0"]) if DATE.match(date(w["text"]))]
        if "PAYMENT" in story.split() and "RECEIVED" in story.split() and "YOU" in story.split():
            story = "PAYMENT RECEIVED, THANK YOU"
        story = story.strip(" |[]{}")
        if any(t in story.upper() for t in scanned.TOTALS) or not (story or any(r in row for r in ("debit", "credit", "amount"))):
            continue
        number = lambda r, row=row: Decimal(row[r].replace(",", "")) if r in row else None
        out.append((n + 1, dates[0], dates[1] if len(dates) > 1 else None, story or "Unrecognized transaction", *(number(r) for r in FIELDS)))
    return out


def test_regions_against_plain_loops(spark):
    rnd = random.Random(12)
    primary, numeric, want = [], [], {}
    heads = [["Date", "Details", "Withdrawals", "Deposits", "Balance"], ["Txn", "Date", "Value", "Date", "Particulars", "Amount", "Closing", "Balance"], ["Date", "Balance"], ["Description", "Debit", "Credit"]]
    for page in range(120):
        mine, other = [], []
        put = lambda text, x, top, line, mine=mine: mine.append({"text": text, "x0": float(x), "x1": float(x + 40), "top": float(top), "line": line})
        for k, t in enumerate(rnd.choice(heads)):
            put(t, 20 + 90 * k, 150 + k / 100, 1)
        for n in range(rnd.randrange(0, 7)):
            y = 205 + n * rnd.choice([30, 60, 60, 140]) + n / 10
            put(rnd.choice(["01/02/2024", "|5-Mar-24,", "2024.03.01", "Shop"]), 20, y, 10 + 3 * n)
            if rnd.random() < 0.4:
                put("02/02/2024", 110, y + 1, 10 + 3 * n)
            for k, t in enumerate(rnd.sample(["Shop", "PAYMENT", "RECEIVED", "YOU", "1234567", "CR", "TOTAL", "[x]", "12"], rnd.randrange(0, 5))):
                put(t, 200 + 10 * k, y + rnd.choice([2, 9]), 11 + 3 * n)
            for k in range(rnd.randrange(0, 4)):
                x, t = rnd.randrange(180, 420), rnd.choice(["1,000.50", "75.00", "(20.25)", "0.00", "75", "2024", "-5.00", "$9.10"])
                put(t, x, y + k, 12 + 3 * n)
                if rnd.random() < 0.6:
                    other.append({"text": t, "x0": float(x + rnd.choice([1, 3, 11])), "x1": float(x + 41), "top": float(y + k + rnd.choice([0.5, 6, 13]))})
        for i, w in enumerate(mine + other):  # no ties
            w["top"] += i / 10_000
            w["x0"] += i / 1000
        primary += [("d", page, w["text"], w["x0"], w["x1"], w["top"], None, 1, 1, w["line"]) for w in mine]
        numeric += [("d", page, w["text"], w["x0"], w["x1"], w["top"], None, None, None, None) for w in other]
        want |= {(page, r[0]): r[1:] for r in plain_rows(mine, other)}
    frame, more = spark.createDataFrame(primary, WORDS), spark.createDataFrame(numeric, WORDS)
    got = {(r.page_number, r.position): (r.transaction_date, r.value_date, r.description, *(r[f] for f in FIELDS)) for r in scanned.scanned_rows(frame, more).collect()}
    wrong = [(k, got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)]
    assert not wrong, (len(wrong), wrong[:3])
    assert len(want) > 80
    assert scanned.scanned_statement(frame.limit(0), more).count() == 0


def test_regions_travel_with_the_words(spark):
    """Words were joined with the columns of their page, which Spark took for small and broadcast; two joins did it."""
    words = spark.createDataFrame([], WORDS)
    plan = scanned.scanned_rows(words, words)._jdf.queryExecution().analyzed().toString()
    assert not [line for line in plan.splitlines() if "Join " in line]


def test_words_outside_all_regions(spark):
    """Words above the first region, below the last one, and on a page without a key are in none."""
    put = lambda doc, text, x, top, line: (doc, 1, text, float(x), float(x + 40), float(top), None, 1, 1, line)
    page = lambda doc: [
        *(put(doc, t, x, 150, 1) for t, x in (("Date", 20), ("Details", 120), ("Debit", 300), ("Balance", 500))), put(doc, "ABOVE", 120, 269.9, 2),
        *(put(doc, t, x, 300, 3) for t, x in (("01/02/2024", 20), ("Shop", 120), ("5.00", 300))), *(put(doc, t, x, 340, 4) for t, x in (("02/02/2024", 20), ("Cafe", 120), ("6.00", 300))), put(doc, "BELOW", 120, 470, 5),
    ]
    words = spark.createDataFrame(page("a") + page(None) + [put("b", "9.00", 300, 310, 1)], WORDS)
    got = sorted((r.doc_id, r.position, r.description, r.debit) for r in scanned.scanned_rows(words, words.limit(0)).collect())
    assert got == [("a", 1, "Shop", Decimal("5.00")), ("a", 2, "Cafe", Decimal("6.00"))]
