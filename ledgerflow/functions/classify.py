"""Classification by ordered rules: direction, type, channel, category, question intent, document kind and currency."""

from __future__ import annotations

from ledgerflow.functions import vocabulary as v
from ledgerflow.functions.dialect import Dialect
from ledgerflow.functions.text import normalised


def direction(d: Dialect, text: str) -> str:
    """Direction of a description without amount columns; without evidence it is a debit."""
    return d.first_case([(d.any_text(f"upper({text})", v.CREDIT_TERMS), "'credit'"), (d.any_text(f"upper({text})", v.DEBIT_TERMS), "'debit'")], "'debit'")


def _has_token(d: Dialect, text: str, tokens: list[str]) -> str:
    return d.matches(text, rf"(^|[\s/-])({'|'.join(tokens)})([\s/-]|$)")


def transaction_type(d: Dialect, text: str, direction: str) -> str:
    """The first type whose terms the description contains; rails with a credit are transfers, else a purchase or other."""
    up = d.replaced(f"upper(trim({text}))", r"\s+", " ")
    starts = "startswith" if d.spark else "starts_with"
    reward = f"({d.any_text(up, ['CASHBACK', 'CASH BACK'])} or ({_has_token(d, up, ['SELECT'])} and {_has_token(d, up, ['SPEND'])} and {_has_token(d, up, ['CBK'])}))"
    more = {
        "fee": f" or {starts}({up}, 'CHARGE ') or {d.matches(up, ' CHARGE$')}",
        "cash_withdrawal": f" or {starts}({up}, 'ATM')",
        "tax": f" or {up} = 'TAX' or {starts}({up}, 'TAX ') or {starts}({up}, 'GOVERNMENT ')",
        "transfer": f" or {_has_token(d, up, v.TRANSFER_TOKENS)}",
    }
    cases = [(reward, "'cashback'"), *((f"({d.any_text(up, terms)}{more.get(kind, '')})", f"'{kind}'") for kind, terms in v.TYPE_TERMS.items())]
    cases += [(d.any_text(up, v.LATE_PAYMENT_TERMS), "'payment'"), (f"({_has_token(d, up, v.RAILS)} and {direction} = 'credit')", "'transfer'"), (f"{direction} = 'credit'", "'other'")]
    return d.first_case(cases, "'purchase'")


def channel(d: Dialect, text: str) -> str:
    return d.first_case([(f"contains(upper({text}), '{c}')", f"'{c}'") for c in v.CHANNELS])


def _ranked() -> list[tuple[str, str, float, list[str]]]:
    """Rules by falling score, named merchants before words, else in order: the first that holds is the best."""
    return sorted(v.MERCHANT_RULES + v.WORD_RULES, key=lambda r: -r[2])


def category_rule(d: Dialect, text: str) -> str:
    """Number of the best rule that a normalised text meets (its place in ``rules``), null without one.

    If no alias is contained, a word that shares all but the last letters with a long one-word alias meets its rule, with
    a score 0.02 lower (0.90 at least)."""
    ranked = _ranked()
    exact = [(d.any_text(text, r[3]), str(i)) for i, r in enumerate(ranked)]
    near = []
    for i, (_, _, _, aliases) in sorted(((i, r) for i, r in enumerate(ranked) if r in v.WORD_RULES), key=lambda x: (-max(0.9, x[1][2] - 0.02), v.WORD_RULES.index(x[1]))):
        tests = []
        for a in aliases:
            if " " not in a and len(a) >= 6:
                common = max(6, len(a) - 2)
                least, most = max(len(a) - 2, common) - common, len(a) + 2 - common
                tests.append(rf"{a[:common]}[a-z0-9]{{{least},{most}}}")
        if tests:
            near.append((d.matches(text, rf"(^| )({'|'.join(tests)})( |$)"), str(1000 + i)))
    return d.first_case(exact + near, "cast(null as int)")


def rules() -> list[tuple[int, str, str, float]]:
    """(number, category, subcategory, score) of every outcome of ``category_rule``."""
    ranked = _ranked()
    exact = [(i, r[0], r[1], r[2]) for i, r in enumerate(ranked)]
    return exact + [(1000 + i, r[0], r[1], round(max(0.9, r[2] - 0.02), 2)) for i, r in enumerate(ranked) if r in v.WORD_RULES]


def rule_part(d: Dialect, number: str, part: int) -> str:
    """Category (1), subcategory (2) or score (3) of a rule's number."""
    ranked = _ranked()
    item = lambda values: d.item(d.array(values), f"{number} % 1000 + 1")
    if part < 3:
        return item([d.text(r[part - 1]) for r in ranked])
    exact = item([f"cast({r[2]} as double)" for r in ranked])
    near = item([f"cast({round(max(0.9, r[2] - 0.02), 2)} as double)" for r in ranked])
    return f"(case when {number} >= 1000 then {near} else {exact} end)"


def keyword_hits(d: Dialect, text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({text}, {d.text(w)}) as int)" for w in words) + ")"


def keyword_category(d: Dialect, text: str) -> tuple[str, str]:
    """(category, hits) by most keywords contained in a lower-case text, the first category on ties; null without one."""
    hits = {c: keyword_hits(d, text, w) for c, w in v.KEYWORDS.items()}
    most = f"greatest({', '.join(hits.values())})"
    return d.first_case([(f"{most} = 0", "null"), *((f"{h} = {most}", d.text(c)) for c, h in hits.items())]), most


def best_keywords(d: Dialect, text: str) -> str:
    """The same for Spark as one struct (h: hits, o: order, c: category), so that each keyword is sought once."""
    each = (f"named_struct('h', {keyword_hits(d, text, w)}, 'o', {-i}, 'c', {d.text(c)})" for i, (c, w) in enumerate(v.KEYWORDS.items()))
    return f"array_max(array({', '.join(each)}))"


def question_category(d: Dialect, question: str) -> str:
    """The category of the longest category word in a question."""
    pairs = [(w, c) for c, ws in v.CATEGORY_WORDS.items() for w in ws]
    return d.first_case([(d.matches(question, rf"\b{w}\b"), d.text(c)) for w, c in sorted(pairs, key=lambda p: -len(p[0]))])


def intent(d: Dialect, question: str, category: str) -> str:
    cases = []
    for name, pattern in v.INTENTS:
        test = d.matches(question, pattern)
        cases.append((f"({test} or {category} is not null)" if name == "category_spend" else test, f"'{name}'"))
    return d.first_case(cases, "'general'")


def signal_score(d: Dialect, text: str, signals: dict[str, int]) -> str:
    return "(" + " + ".join(f"case when contains({text}, {d.text(s)}) then {w} else 0 end" for s, w in signals.items()) + ")"


def document_kind(d: Dialect, text: str) -> str:
    card, bank = signal_score(d, text, v.CARD_SIGNALS), signal_score(d, text, v.BANK_SIGNALS)
    return d.first_case([(f"{card} = 0 and {bank} = 0", "'unknown'"), (f"{card} > {bank}", "'credit_card'")], "'bank_account'")


def currency(d: Dialect, text: str) -> str:
    """The first currency that a text names."""
    return d.first_case([(d.matches(text, f"(?i)({'|'.join(patterns)})"), f"'{code}'") for code, patterns in v.CURRENCY_WORDS.items()], "'UNKNOWN'")


def is_metadata(d: Dialect, text: str) -> str:
    return d.any_text(f"lower({text})", v.METADATA_TERMS)


def searchable(d: Dialect, *parts: str) -> str:
    return normalised(d, "concat_ws(' ', " + ", ".join(parts) + ")")
