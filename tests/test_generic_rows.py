"""Rows by nearness against plain loops; dates against strptime."""

import random
import re
from collections import Counter
from datetime import date, datetime

from ledgerflow.functions.vocabulary import METADATA_TERMS
from ledgerflow.operators import generic_rows as g
from ledgerflow.operators.regions import physical_rows

WORDS = "doc_id string, page_number int, text string, x0 double, x1 double, top double, bottom double"
COLUMNS = "doc_id string, role string, x0 double, x1 double, top double"
SHORT = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG = "january february march april may june july august september october november december".split()
MONTHS = {m: i + 1 for i, m in enumerate(SHORT)} | {m: i + 1 for i, m in enumerate(LONG)} | {"sept": 9}
FORMATS = "%d %b %y|%d-%b-%Y|%d-%b-%y|%d-%B-%Y|%d-%B-%y|%d %B %Y|%d %b %Y|%d %B %y|%d/%m/%Y|%d/%m/%y|%d-%m-%Y|%d-%m-%y|%Y-%m-%d|%Y/%m/%d|%d.%m.%Y|%d.%m.%y".split("|")


def parsed(text):
    text = re.sub(r"\s+", " ", text.strip())
    if not 4 <= len(text) <= 32:
        return None
    plain = re.sub(r"\s*([/.\-])\s*", r"\1", text)
    for f in FORMATS:
        try:
            return datetime.strptime(plain, f).strftime("%Y-%m-%d").zfill(10)
        except ValueError:
            pass
    parts = plain.split()
    month = MONTHS.get(parts[1].lower().rstrip(".")) if len(parts) > 1 else None
    if len(parts) == 3 and month and parts[0].isdigit() and parts[2].isdigit():
        year = int(parts[2])
        try:
            return date(year + (2000 if year <= 49 else 1900) if year < 100 else year, month, int(parts[0])).isoformat()
        except ValueError:
            return None
    if len(parts) == 2 and month and parts[0].isdigit() and 1 <= int(parts[0]) <= 31:
        return f"0001-{month:02d}-{int(parts[0]):02d}"
    return None


def test_dates(spark):
    texts = ["16 Jun 19", "16-JUN-2019", "16-June-19", "16 June 2019", "1/2/2024", "01/02/24", "31/02/2024", "2024-3-1", "2024/03/01", "1.2.24", "01-02-70", "1-2-68", "16 Jun. 19", "16 Sept 50", "16 sept 49", "9 AUG", "32 Aug", "16 Jun",
             "5 12 2019", "16 / 06 / 2019", "16 - Jun - 19", "2019 Jun 16", "Jun 16 2019", "June", "12", "", "1/2-2024", "16 Foo 19", "16 may 2019", "016 Aug 20", "16 Aug 123", "16 Aug 5", "5 Aug.", "30 Feb 2020", "29 Feb 2020", "3 March", "00 Jan 20"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").selectExpr("x", f"{g.date_text('x')} as d").collect()
    assert {r.x: r.d for r in rows} == {t: parsed(t) for t in texts}


def number(text):
    if text.upper().endswith(("CR", "DR")):
        text = text[:-2]
    return bool(re.fullmatch(r"-?\d+(\.\d+)?", re.sub(r"[,()₹$€£]|AED|INR|USD|EUR", "", text).strip()))


def begins(t):
    return bool(re.fullmatch(r"\d{1,2}", t) and 1 <= int(t) <= 31 or re.fullmatch(r"\d{4}", t) and 1900 <= int(t) <= 2100 or t.lower().rstrip(".") in MONTHS)


def fragment(t):
    return begins(t) or bool(re.fullmatch(r"\d{2}", t)) or bool(re.fullmatch(r"\d{3}", t) and int(t) <= 99)


def groups_of(ts):
    yearly = lambda i: i < len(ts) and re.fullmatch(r"\d{2,4}", ts[i]["text"]) and (int(ts[i]["text"]) <= 99 or 1900 <= int(ts[i]["text"]) <= 2100)
    out = []
    for upright in (False, True):
        for s in range(len(ts)):
            if not begins(ts[s]["text"]):
                continue
            at = [s]
            for i in range(s + 1, min(s + 4, len(ts))):
                if upright:
                    drop = ts[i]["top"] - ts[at[-1]]["bottom"]
                    if abs(ts[i]["c"] - ts[s]["c"]) > 18 or drop > 14:
                        break
                    if drop < -2:
                        continue
                elif abs(ts[i]["top"] - ts[s]["top"]) > 4 or ts[i]["x0"] - ts[at[-1]]["x1"] > 18:
                    break
                at = [*at, i]
                value = parsed(" ".join(ts[j]["text"] for j in at))
                if value and not (len(at) == 2 and yearly(i + 1)):
                    item = (at, value, (min(ts[j]["x0"] for j in at) + max(ts[j]["x1"] for j in at)) / 2)
                    if item not in out:
                        out.append(item)
                    break
    return out


def row_of(tokens, cols):
    ts = sorted(({"text": t, "x0": a, "x1": b, "c": (a + b) / 2, "top": y, "bottom": z} for t, a, b, y, z in tokens), key=lambda t: t["x0"])
    cols = sorted(({"role": r, "x0": a, "x1": b, "c": (a + b) / 2} for r, a, b in cols), key=lambda c: (c["x0"], c["x1"], c["role"]))
    groups, used, taken, out = groups_of(ts), set(), set(), {}
    for c in (c for c in cols if c["role"].endswith("date")):
        near = sorted((abs(m - c["c"]), n) for n, (at, _, m) in enumerate(groups) if not taken & set(at))
        if near and near[0][0] <= 80:
            at, out[c["role"]], _ = groups[near[0][1]]
            used |= set(at)
            taken |= set(at)
            continue
        whole = [(abs(t["c"] - c["c"]), i) for i, t in enumerate(ts) if parsed(t["text"]) and i not in used]
        if whole:
            out[c["role"]] = ts[min(whole)[1]]["text"]
            used.add(min(whole)[1])
    identifier = lambda i: i < len(ts) and re.match(r"[A-Za-z]?\d{6,}$", ts[i]["text"])
    column = next((c for c in cols if c["role"] == "transaction_id"), None)
    ids = [(abs(t["c"] - column["c"]), i) for i, t in enumerate(ts) if column and i not in used and (identifier(i) or t["text"].upper() == "TFR")]
    if ids:
        i = min(ids)[1]
        out["transaction_id"] = ts[i]["text"]
        used.add(i)
        if ts[i]["text"].upper() == "TFR" and identifier(i + 1):
            out["transaction_id"] = "TFR " + ts[i + 1]["text"]
            used.add(i + 1)
    money = [c for c in cols if c["role"] in ("amount", "debit", "credit", "balance")]
    left = [i for i, t in enumerate(ts) if i not in used and number(t["text"])]
    placed = {}
    rate = lambda i, c: abs(ts[i]["c"] - c["c"]) - (1000 if c["x0"] - 5 <= ts[i]["c"] <= c["x1"] + 5 else 0)
    if any(c["role"] in ("debit", "credit") for c in money):
        gone = set()
        for _, i, k in sorted((rate(i, c), i, k) for i in left for k, c in enumerate(money) if rate(i, c) <= 70):
            if i not in gone and -1 - k not in gone:
                placed[k] = i
                gone |= {i, -1 - k}
        order = sorted(placed, key=lambda k: (rate(placed[k], money[k]), placed[k], k))
        chosen = {money[k]["role"]: placed[k] for k in order}
    else:
        chosen = {}
        for c in money:
            if left:
                chosen[c["role"]] = min(left, key=lambda i, c=c: (rate(i, c), i))
                left.remove(chosen[c["role"]])
    used |= set(chosen.values())
    out |= {r: ts[i]["text"] for r, i in chosen.items()}
    if any(c["role"] == "description" for c in cols):
        skip = lambda i, t: i in used or t.upper() in ("DR", "CR") or parsed(t) or number(t) or fragment(t) or "transaction_id" in out and (t.upper() == "TFR" or identifier(i))
        out["description"] = " ".join(t["text"] for i, t in enumerate(ts) if not skip(i, t["text"])) or None
    return out


def is_transaction(row):
    dated = row.get("transaction_date") or row.get("posting_date") or row.get("value_date")
    said = " ".join(v.lower() for v in row.values() if v)
    return bool(dated and (row.get("amount") or row.get("debit") or row.get("credit")) and (row.get("description") or row.get("transaction_id")) and not any(t in said for t in METADATA_TERMS))


FIELDS = ["transaction_date", "posting_date", "value_date", "description", "amount", "debit", "credit", "balance", "transaction_id"]


def test_rows_against_plain_loops(spark):
    rnd = random.Random(5)
    pool = ["01/02/2024", "16", "7", "Jun", "June", "aug.", "19", "2019", "5-Mar-24", "260.00", "2,845.15", "(3.50)", "10.00CR", "45", "S633139", "123456", "TFR", "ORDER", "Shop", "DR", "opening", "balance"]
    roles = ["transaction_date", "value_date", "posting_date", "description", "amount", "debit", "credit", "balance", "transaction_id", "amount"]
    words, columns, want, everything = [], [], {}, {}
    for n in range(500):
        doc = f"d{n}"
        cols = [(r, float(x), float(x + rnd.choice([30, 40]))) for r in rnd.sample(roles, rnd.randrange(2, 9)) for x in [rnd.randrange(0, 400, 20)]]
        tokens = [(rnd.choice(pool), x + i / 100, x + 15.0 + i / 100, 50.0 + rnd.choice([0, 1, 2]), 51.0 + rnd.choice([0, 0, 8])) for i, x in enumerate(rnd.sample(range(0, 420, 11), rnd.randrange(2, 14)))]
        columns += [(doc, *c, 10.0) for c in cols]
        words += [(doc, 1, *t) for t in tokens] + [(doc, 1, "Head", 0.0, 9.0, 12.0, 14.0)]
        everything[doc] = row_of(tokens, cols)
        if is_transaction(everything[doc]):
            years = Counter(t[0] for t in sorted(tokens, key=lambda t: (t[3], t[1])) if re.fullmatch(r"(19|20|21)\d{2}", t[0]))
            year = max(years, key=years.get) if years else None
            want[doc] = {k: year + v[4:] if year and v and v.startswith("0001-") else v for k, v in everything[doc].items()}
    frame, heads = spark.createDataFrame(words, WORDS), spark.createDataFrame(columns, COLUMNS)
    plain = lambda row: tuple(row.get(f) for f in FIELDS)
    rows = physical_rows(frame.filter("top > 20"), running_mean=False)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in g.parsed_rows(rows, heads).collect()}
    wrong = [(d, got[d], plain(v)) for d, v in everything.items() if got[d] != plain(v)]
    assert not wrong, (len(wrong), wrong[:3])
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in g.generic_rows(frame, heads).collect()}
    assert got == {d: plain(v) for d, v in want.items()} and len(want) > 60


def test_dates_below_each_other_and_empty(spark):
    words = [("d", 1, t, x, x + 20.0, y, y + 3.0) for t, x, y in (("16", 20.0, 50.0), ("Jun", 21.0, 53.0), ("19", 22.0, 54.0), ("Shop", 100.0, 50.0), ("5.00", 200.0, 50.0))]
    columns = spark.createDataFrame([("d", r, x, x + 20, 10.0) for r, x in (("transaction_date", 20.0), ("description", 100.0), ("amount", 200.0))], COLUMNS)
    frame = spark.createDataFrame(words, WORDS)
    row = g.generic_rows(frame, columns).collect()
    assert [(r.transaction_date, r.description, r.amount) for r in row] == [("2019-06-16", "Shop", "5.00")]
    assert g.generic_rows(frame.limit(0), columns).count() == 0 and g.generic_rows(frame, columns.limit(0)).count() == 0
