"""Campaigns over the whole ledger against all pairs."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerflow.functions import text
from ledgerflow.functions.dialect import SPARK as S
from ledgerflow.operators import memory
from ledgerflow.plans.adapters import ledger
from ledgerflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, anchors):
    """All pairs of (position, direction, family), by the rule of two rows."""
    alike = {}
    out = set()
    for a, da, fa in rows:
        for p, dp, fp in rows if a in anchors else ():
            if a != p and (da or "").lower() == (dp or "").lower() and fa and fp:
                if (fa, fp) not in alike:
                    alike[fa, fp] = fa == fp or SequenceMatcher(None, fa, fp).ratio() >= 0.92
                if alike[fa, fp]:
                    out.add((a, p))
    return out


def spelled_out(rows):
    pairs, hot = [(r.anchor, r.position) for r in rows if None not in (r.anchor, r.position)], {}
    for r in rows:
        if None in (r.anchor, r.position):
            hot.setdefault((r.direction, r.family), ([], []))[r.anchor is None].append(r.position if r.anchor is None else r.anchor)
    pairs += [(a, p) for anchors, positions in hot.values() for a in anchors for p in positions if a != p]
    assert len(pairs) == len(set(pairs))
    return set(pairs), len(hot)


def test_queries_reach_the_whole_ledger(spark):
    family = F.expr(text.family(S, text.family_key(S, "coalesce(nullif(merchant, ''), description_raw)"))).alias("family")
    rows = [tuple(r) for r in ledger(spark, SF).select("position", "direction", family).collect()]
    want = brute(rows, {p for p, _, _ in rows if p % 100 == 0})
    got, _ = spelled_out(QUERIES["campaign_candidates"](spark, SF).collect())
    assert got == want and any(p % 50 for _, p in want)
    before = {r.position: (r.category, r.requires_review) for r in ledger(spark, SF).collect()}
    applied = {r.position: (r.category, r.requires_review) for r in QUERIES["campaign_apply"](spark, SF).collect()}
    reached = {p for _, p in want}
    assert applied == {p: ("Groceries", False) if p in reached else v for p, v in before.items()}


def test_groups_hold_every_pair(spark):
    names = ["Hot Shop"] * 60 + ["hot shop 7"] * 20 + ["Golden Bakery House", "Golden Bakery Houses", "Lonely", "  ", None]
    rows = [(i, [None, "debit", "DEBIT", "credit"][i % 4], n, "Fallback Store") for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "position long, direction string, merchant string, description_raw string")
    for step, some in ((3, True), (40, False), (1, True)):
        anchors = frame.filter(f"position % {step} = 0")
        pairs = {tuple(r) for r in memory.campaign(frame, anchors).collect()}
        got, hot = spelled_out(memory.campaign_groups(frame, anchors).collect())
        assert got == pairs and bool(hot) == some
        assert {r.position for r in memory.campaign_positions(frame, anchors).collect()} == {p for _, p in pairs}
