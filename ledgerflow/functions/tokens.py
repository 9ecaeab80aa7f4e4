"""What a single word of a statement may be: date, part of one, number, reference.  One expression each, for Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from ledgerflow.functions.dialect import Dialect

# The shapes of dates, numbers and references.
FULL_DATES = [r"^\d{1,2}[-/][A-Za-z]{3}[-/]\d{2,4}$", r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$", r"^\d{1,2}\.\d{1,2}\.\d{2,4}$", r"^\d{1,2}/\d{1,2}/\d{2,4}$"]
SCANNED_DATE = r"^(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/][A-Za-z]{3,9}[-/]\d{2,4})$"
PRINTED_NUMBER = r"^[(\-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?([cC][rR]|[dD][rR])?\)?$"
SCANNED_NUMBER = r"^-?\d[\d,]*(\.\d+)?$"
REFERENCES = [r"^[A-Za-z]\d{5,}$", r"^[A-Za-z]{1,4}\d{4,}$", r"^\d{6,}$", r"^[A-Za-z0-9]{6,}/[A-Za-z0-9/_-]+$"]
SHORT_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONG_MONTHS = ["january", "february", "march", "april", "june", "july", "august", "september", "sept", "october", "november", "december"]
CREDIT_WORDS = ["SALARY", "CREDIT", "DEPOSIT", "RECEIVED", "REFUND", "REVERSAL", "CASHBACK", "CASH BACK", "CBK", "INTEREST"]
DEBIT_WORDS = ["DEBIT", "ATM", "FEE", "CHARGE", "WITHDRAWAL", "PURCHASE", "PAYMENT TO", "PAYMENT FOR", "TRANSFER TO"]
NOT_DEBIT = ["PAYMENT RECEIVED", "RECEIVED PAYMENT"]

_MARKS = r"[|\[\]*\\(){}]"


def _any(d: Dialect, x: str, patterns: list[str]) -> str:
    return "(" + " or ".join(d.matches(x, p) for p in patterns) + ")"


def _range(d: Dialect, x: str, pattern: str, low: int, high: int) -> str:
    """A number of that shape and size; the cast sees nothing else."""
    return f"(case when {d.matches(x, pattern)} then cast({x} as bigint) between {low} and {high} else false end)"


def day(d: Dialect, x: str) -> str:
    """HLP4."""
    return _range(d, x, r"^\d{1,2}$", 1, 31)


def year(d: Dialect, x: str) -> str:
    return _range(d, x, r"^\d{4}$", 1900, 2100)


def month(d: Dialect, x: str) -> str:
    return d.one_of(d.replaced(f"lower({x})", r"\.+$", ""), SHORT_MONTHS + LONG_MONTHS)


def full_date(d: Dialect, x: str) -> str:
    """HLP3."""
    return _any(d, x, FULL_DATES)


def date_start(d: Dialect, x: str) -> str:
    """A day, a month or a year, with which a split date may begin (LAY16)."""
    return f"({day(d, x)} or {year(d, x)} or {month(d, x)})"


def date_fragment(d: Dialect, x: str) -> str:
    """Any part of a split date; two digits may be a year (LAY17)."""
    return f"({date_start(d, x)} or {d.matches(x, r'^\d{2}$')} or {_range(d, x, r'^\d{3}$', 0, 99)})"


def header_date(d: Dialect, x: str) -> str:
    """A whole date or a part of one, as structure detection counts them (STR17)."""
    months = "|".join(SHORT_MONTHS)
    low = f"lower({x})"
    whole = [rf"^\d{{1,2}}[-/]({months})[-/]\d{{2,4}}$", rf"^\d{{4}}[-/]({months})[-/]\d{{1,2}}$", r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$", r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"]
    named = f"({d.one_of(f'substring({low}, 1, 3)', SHORT_MONTHS)} and length({x}) <= 9)"
    return f"({_any(d, low, whole)} or {day(d, x)} or {named} or {year(d, x)} or {d.matches(x, r'^\d{2}$')})"


def number(d: Dialect, x: str) -> str:
    """Digits with separators, sign, brackets, CR or DR (HLP6)."""
    return d.matches(d.replaced(x, " ", ""), PRINTED_NUMBER)


def amount(d: Dialect, x: str) -> str:
    """A number once CR or DR, currency signs and separators are gone (LAY13)."""
    bare = d.replaced(d.replaced(x, r"([cC][rR]|[dD][rR])$", ""), r"[,()₹$€£]|AED|INR|USD|EUR", "")
    return d.matches(f"trim({bare})", r"^-?\d+(\.\d+)?$")


def plain_number(d: Dialect, x: str) -> str:
    """A number with commas anywhere, whole in brackets or not (STR18)."""
    bare = d.replaced(d.replaced(x, ",", ""), r"^\((.*)\)$", r"$1" if d.spark else r"\1")
    return d.matches(bare, r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def scanned_date(d: Dialect, x: str) -> str:
    """A date once the marks that scanning leaves are off its ends (HLP19, HLP20)."""
    return d.matches(d.replaced(x, rf"^({_MARKS}|,)+|({_MARKS}|,)+$", ""), SCANNED_DATE)


def scanned_number(d: Dialect, x: str) -> str:
    """HLP21."""
    return d.matches("trim(" + d.replaced(d.replaced(x, rf"^({_MARKS}|[;:])+|({_MARKS}|[;:])+$", ""), r"[$]", "") + ")", SCANNED_NUMBER)


def begins_with_date(d: Dialect, line: str) -> str:
    """HLP18."""
    return scanned_date(d, d.extracted(f"trim({line})", r"^\S+"))


def identifier(d: Dialect, x: str) -> str:
    """LAY15."""
    return d.matches(x, r"^[A-Za-z]?\d{6,}$")


def transfer_or_identifier(d: Dialect, x: str) -> str:
    """LAY14."""
    return f"(upper({x}) = 'TFR' or {identifier(d, x)})"


def reference(d: Dialect, x: str) -> str:
    """HLP8."""
    return _any(d, x, REFERENCES)


def late_year(d: Dialect, x: str) -> str:
    """A year of two digits lies in 1950 to 2049 (DT7); null for what is no number of up to four digits."""
    n = f"cast({x} as int)"
    return f"(case when {d.matches(x, r'^\d{1,4}$')} then case when {n} <= 49 then 2000 + {n} when {n} < 100 then 1900 + {n} else {n} end end)"


def first_number(d: Dialect, x: str) -> str:
    """The first number of a text, up to two decimals (DOC11)."""
    return f"try_cast({d.extracted(d.replaced(f'trim({x})', ',', ''), r'-?\d+(\.\d{1,2})?')} as double)"


def _wording(d: Dialect, x: str) -> str:
    return d.replaced(f"upper({x})", "[^A-Z0-9]+", " ")


def credit_wording(d: Dialect, x: str) -> str:
    """OCR7."""
    return d.any_text(_wording(d, x), CREDIT_WORDS)


def debit_wording(d: Dialect, x: str) -> str:
    """A received payment is none (OCR8)."""
    return f"(not {d.any_text(_wording(d, x), NOT_DEBIT)} and {d.any_text(_wording(d, x), DEBIT_WORDS)})"


#: Each test by the name of its column; words come trimmed.
TESTS: dict[str, Callable[[Dialect, str], str]] = {
    f.__name__: f
    for f in (
        day, month, full_date, date_start, date_fragment, header_date, number, amount, plain_number, scanned_date, scanned_number, begins_with_date,
        identifier, transfer_or_identifier, reference, late_year, first_number, credit_wording, debit_wording,
    )
}
