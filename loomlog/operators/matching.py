"""What makes a line, and an entry, match."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.regexes import Pattern, check, escape, lift_nots, never_empty, participation, translate
from ..functions.values import mask
from ..plans.query_tree import compile_tree

#: Matches of a line that are looked at for its groups.
MATCHES_PER_LINE = 200


@dataclass
class Matcher:
    """A query over lines: empty, a substring, a pattern or a builder tree. NOTs that lead a pattern rule out entries."""

    query: str = ""
    is_regex: bool = False
    case_sensitive: bool = False
    tree: object = None
    spark: SparkSession | None = None
    pattern: Pattern | None = field(init=False, default=None)
    veto: Pattern | None = field(init=False, default=None)

    def __post_init__(self):
        if self.tree is not None or not self.query:
            return
        if self.is_regex:
            split = lift_nots(self.query)
            if split:
                self.veto = self._built(split[1])
            self.pattern = self._built(split[0] if split else self.query)
        elif not self.case_sensitive:
            self.pattern = self._built(escape(self.query))

    def _built(self, source: str) -> Pattern:
        pattern = translate(source, self.case_sensitive)
        return check(self.spark, pattern) if self.spark is not None else pattern

    def is_match(self, line: Column) -> Column:
        """The positive part on one line."""
        if self.tree is not None:
            return compile_tree(self.tree, line, self.case_sensitive).line
        if not self.query:
            return F.lit(True)
        return line.contains(self.query) if self.pattern is None else line.rlike(self.pattern.java)

    def excludes(self, line: Column) -> Column:
        """A line that rules out its whole entry."""
        if self.tree is not None:
            return compile_tree(self.tree, line, self.case_sensitive).veto
        return F.lit(False) if self.veto is None else line.rlike(self.veto.java)

    def line_matches(self, line: Column) -> Column:
        return ~self.excludes(line) & self.is_match(line)

    def entry_matches(self, text: Column) -> Column:
        """Some line of a newline-joined entry matches and none excludes."""
        lines = F.split(text, "\n")
        return F.exists(lines, self.is_match) & ~F.exists(lines, self.excludes)

    @property
    def group_names(self) -> list[str]:
        if self.tree is not None:
            return [n for n, _ in compile_tree(self.tree, F.lit(""), self.case_sensitive).flags]
        return [n for n, _ in self.pattern.names] if self.pattern is not None and self.is_regex else []

    def group_mask(self, line: Column) -> Column:
        """Bits of the named groups that took part in some match on the line, be it with no character."""
        if self.tree is not None:
            return mask([flag for _, flag in compile_tree(self.tree, line, self.case_sensitive).flags])
        if not self.group_names:
            return F.lit(0).cast("long")

        def took_part(number: int) -> Column:
            found = lambda java, k: F.exists(F.slice(F.regexp_extract_all(line, F.lit(java), F.lit(k)), 1, MATCHES_PER_LINE), lambda v: v != "")
            if never_empty(self.pattern, number):
                return found(self.pattern.java, number)
            java, alone, ahead, behind = participation(self.pattern, number)
            return found(java, ahead) | found(java, behind) | ((line == "") & line.rlike(alone))

        return mask([took_part(number) for _, number in self.pattern.names])

    def isolated(self, text: Column, excluded: Sequence[str] = ()) -> Column:
        """The matched part of an entry's first line that yields one: its named groups that took part, joined by spaces,
        else the whole match. NULL where no line yields, and for queries without a pattern."""
        if self.pattern is None:
            return F.lit(None).cast("string")
        names = [(n, k) for n, k in self.pattern.names] if self.is_regex else []

        def part(line: Column) -> Column:
            whole = F.regexp_extract(line, self.pattern.java, 0)
            if not names:
                return F.when(line.rlike(self.pattern.java), whole)
            kept = [F.regexp_extract(line, self.pattern.java, k) for n, k in names if n not in excluded]
            groups = F.array_join(F.filter(F.array(*kept) if kept else F.array().cast("array<string>"), lambda v: v != ""), " ")
            any_part = F.lit(False)
            for _, k in names:
                any_part = any_part | (F.regexp_extract(line, self.pattern.java, k) != "")
            return F.when(line.rlike(self.pattern.java), F.when(any_part, groups).otherwise(whole))

        parts = F.filter(F.transform(F.split(text, "\n"), part), lambda v: v.isNotNull() & (v != ""))
        return F.try_element_at(parts, F.lit(1))
