"""The few places where Spark SQL and DuckDB write the same expression differently."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Dialect:
    """Builders of SQL expression text.  ``spark`` is what the engine runs, the other is the SQL used to check it."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        if self.spark:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + value.replace("'", "''") + "'"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def replaced(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})" if self.spark else f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def extracted(self, x: str, pattern: str, group: int = 0) -> str:
        """The group of the first match, '' without one."""
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def all_matches(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def array(self, items: Iterable[str]) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def item(self, array: str, index: str) -> str:
        """One-based; null beyond the end."""
        return f"try_element_at({array}, cast({index} as int))" if self.spark else f"list_extract({array}, {index})"

    def split(self, x: str, by: str = " ") -> str:
        return f"split({x}, {self.text(by)})" if self.spark else f"string_split({x}, {self.text(by)})"

    def joined(self, array: str, by: str = " ") -> str:
        return f"array_join({array}, {self.text(by)})" if self.spark else f"array_to_string({array}, {self.text(by)})"

    def each(self, array: str, body: Callable[[str], str]) -> str:
        return f"transform({array}, w -> {body('w')})" if self.spark else f"[{body('w')} for w in {array}]"

    def kept(self, array: str, test: Callable[[str], str]) -> str:
        return f"filter({array}, w -> {test('w')})" if self.spark else f"[w for w in {array} if {test('w')}]"

    def place(self, array: str, value: str) -> str:
        """One-based place of the first equal item, 0 without one."""
        return f"cast(array_position({array}, {value}) as int)" if self.spark else f"coalesce(list_position({array}, {value}), 0)"

    def head(self, array: str, count: str) -> str:
        return f"slice({array}, 1, {count})" if self.spark else f"list_slice({array}, 1, {count})"

    def size(self, array: str) -> str:
        return f"cast(size({array}) as bigint)" if self.spark else f"cast(len({array}) as bigint)"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def holds(self, array: str, value: str) -> str:
        return f"array_contains({array}, {value})" if self.spark else f"list_contains({array}, {value})"

    def distinct(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))" if self.spark else f"list_sort(list_distinct({array}))"

    def days_after(self, date: str, days: str) -> str:
        return f"date_add({date}, cast({days} as int))" if self.spark else f"({date} + cast({days} as integer))"

    def date_of(self, iso: str) -> str:
        """The date of a text 'yyyy-mm-dd', null if there is no such day."""
        return f"cast(try_to_timestamp({iso}, 'yyyy-MM-dd') as date)" if self.spark else f"try_cast(try_strptime({iso}, '%Y-%m-%d') as date)"

    def month(self, date: str) -> str:
        return f"date_format({date}, 'yyyy-MM')" if self.spark else f"strftime({date}, '%Y-%m')"

    def number(self, x: str, kind: str = "double") -> str:
        return f"try_cast({x} as {kind})"

    def money(self, x: str) -> str:
        return f"format_number({x}, 2)" if self.spark else f"format('{{:,.2f}}', cast({x} as double))"

    def padded(self, x: str, width: int, fill: str = "0") -> str:
        return f"lpad(cast({x} as string), {width}, '{fill}')" if self.spark else f"lpad(cast({x} as varchar), {width}, '{fill}')"

    def any_text(self, x: str, terms: Iterable[str]) -> str:
        """Whether x contains one of the terms."""
        return "(" + " or ".join(f"contains({x}, {self.text(t)})" for t in terms) + ")"

    def first_case(self, cases: Iterable[tuple[str, str]], otherwise: str = "null") -> str:
        return "case " + " ".join(f"when {test} then {value}" for test, value in cases) + f" else {otherwise} end"

    def one_of(self, x: str, values: Iterable[str]) -> str:
        return f"{x} in ({', '.join(self.text(v) for v in values)})"


SPARK, DUCKDB = Dialect(True), Dialect(False)
