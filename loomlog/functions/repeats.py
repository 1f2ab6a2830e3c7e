"""Repeated groups that end no task. Java matches a repeated group of no fixed form, as `(?:\\w+ )*`, by recursion, so some
thousand repetitions in one line overflow the stack and the executor's task dies. Such groups are rewritten:

* alternatives of one character each become a class, which is matched by a loop;
* where giving a repetition back can never lead to a match, the repeat becomes possessive, which is a loop too. That is so
  where what follows can always match, or where it begins with no character that a repetition can begin with and a
  repetition can end in one place only. Possessive repeats of Java leave groups set by attempts that failed, so where a
  repetition has groups, all repetitions but the last are matched without them;
* any other repeat is bounded, such that all of a pattern's repeats together stay within DEPTH steps.

The first two find the same matches and groups. With the third, a match that needs more repetitions is not found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

#: Steps of recursion that a pattern's bounded repeats may take; a task's stack of 1 MB holds several times as many.
DEPTH = 4000
#: Repeats up to this number stay as they are.
FEW = 32
# Characters are told apart if they are ASCII; of the others, white space (128), digits (129), word characters (130), the rest (131).
OTHERS = frozenset(range(128, 132))
EVERY = frozenset(range(132))
ESCAPES = {"s": {128}, "d": {129}, "w": {129, 130}}
#: ASCII letters that others fold to when case is ignored.
FOLDED = set("ksi")
FOREVER = float("inf")


@dataclass
class Node:
    """A part of a pattern, from start to end. What of a repeat stands behind its body begins at quantifier."""

    kind: str  # chars, sequence, either, group, repeat, zero (look, anchor), end (of the text), opaque
    start: int
    end: int = 0
    inside: list[Node] = field(default_factory=list)
    chars: frozenset = EVERY
    low: int = 1
    high: float = 1
    mode: str = ""
    quantifier: int = 0  # of a group: where its content begins
    alone: bool = False  # an atomic group or a look, behind which nothing is given back

    def width(self) -> float | None:
        """Characters taken, where that is one number."""
        if self.kind in ("chars", "zero", "end"):
            return int(self.kind == "chars")
        widths = [n.width() for n in self.inside]
        if self.kind == "opaque" or None in widths:
            return None
        if self.kind == "repeat":
            return widths[0] * self.low if self.low == self.high else None
        return sum(widths) if self.kind != "either" else widths[0] if len(set(widths)) == 1 else None

    def begins(self) -> tuple[frozenset, bool]:
        """Characters it can begin with, and whether it can match nothing wherever it stands."""
        if self.kind in ("chars", "end"):
            return (self.chars if self.kind == "chars" else frozenset()), False
        if self.kind in ("zero", "opaque"):
            return EVERY, False
        if self.kind == "either":
            parts = [n.begins() for n in self.inside]
            return frozenset().union(*(c for c, _ in parts)), any(empty for _, empty in parts)
        if self.kind == "repeat":
            chars, empty = self.inside[0].begins()
            return chars, empty or self.low == 0
        return followed(self.inside, (frozenset(), True))

    def idle(self) -> bool:
        """Whether it can match without a character."""
        if self.kind == "repeat":
            return self.low == 0 or self.inside[0].idle()
        if self.kind == "either":
            return any(n.idle() for n in self.inside)
        return self.kind != "chars" and (self.kind not in ("sequence", "group") or all(n.idle() for n in self.inside))

    def plain(self) -> bool:
        """Whether Java repeats it by a loop: characters in a row."""
        if self.kind == "repeat":
            return self.low == self.high and self.inside[0].plain()
        return self.kind == "chars" or self.kind in ("sequence", "group") and bool(self.inside) and all(n.plain() for n in self.inside)

    def steps(self) -> int:
        return 1 + sum(n.steps() for n in self.inside)


def followed(nodes: list[Node], after: tuple[frozenset, bool]) -> tuple[frozenset, bool]:
    """What nodes in a row and whatever comes after them can begin with, and whether all of it can match nothing."""
    chars: frozenset = frozenset()
    for node in nodes:
        more, empty = node.begins()
        chars |= more
        if not empty:
            return chars, False
    return chars | after[0], after[1]


def again(node: Node, after: tuple[frozenset, bool]) -> tuple[frozenset, bool]:
    """What can come behind one repetition: the next one, or what comes after all."""
    return node.inside[0].begins()[0] | after[0], after[1] and node.low <= 1


def one_end(node: Node, after: tuple[frozenset, bool]) -> bool:
    """Whether from one start no second end could help what comes after."""
    if after[1] or node.alone or node.width() is not None:
        return True
    if node.kind == "opaque":
        return False
    if node.kind == "repeat":
        body = node.inside[0]
        chars = body.begins()[0]
        return node.mode == "+" or not body.idle() and not chars & after[0] and one_end(body, again(node, after))
    if node.kind == "either":
        begins = [n.begins() for n in node.inside]
        apart = sum(len(c) for c, _ in begins) == len(frozenset().union(*(c for c, _ in begins)))
        return apart and not any(empty for _, empty in begins) and all(one_end(n, after) for n in node.inside)
    return all(one_end(n, followed(node.inside[i + 1 :], after)) for i, n in enumerate(node.inside))


def keeps(node: Node, after: tuple[frozenset, bool]) -> bool:
    """Whether a repeat may be possessive."""
    body = node.inside[0]
    chars = body.begins()[0]
    if body.idle():
        return False
    if after[1]:
        return node.low <= 1 and node.mode == ""
    return not chars & after[0] and one_end(body, (chars | after[0], False))


class Unreadable(Exception):
    pass


class Reader:
    """Parts of a pattern in Java's syntax. In doubt where it has flags in the middle or references, with which nothing is
    shown of what a repeat may do; unreadable where its text has quotes or comments."""

    def __init__(self, java: str):
        self.java = java
        self.at = java.index(")") + 1 if re.match(r"\(\?[a-zA-Z]+\)", java) else 0
        self.fold = "i" in java[: self.at]
        self.doubt = False

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.java):
            raise Unreadable
        return node

    def either(self) -> Node:
        start, branches = self.at, [self.sequence()]
        while self.java.startswith("|", self.at):
            self.at += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else Node("either", start, self.at, branches)

    def sequence(self) -> Node:
        node = Node("sequence", self.at)
        while self.at < len(self.java) and self.java[self.at] not in "|)":
            node.inside.append(self.repeated(self.one()))
        node.end = self.at
        return node

    def repeated(self, body: Node) -> Node:
        found = re.compile(r"(?:([*+?])|\{(\d+)(,?)(\d*)\})([?+]?)").match(self.java, self.at)
        if not found:
            return body
        sign, low, comma, high, mode = found.groups()
        self.at = found.end()
        bounds = {"*": (0, FOREVER), "+": (1, FOREVER), "?": (0, 1)}[sign] if sign else (int(low), int(high) if high else FOREVER if comma else int(low))
        return Node("repeat", body.start, self.at, [body], low=bounds[0], high=bounds[1], mode=mode, quantifier=found.start())

    def one(self) -> Node:
        start, c = self.at, self.java[self.at]
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        self.at += 1
        if c in "^$":
            return Node("zero", start, self.at)
        if c == ".":
            return Node("chars", start, self.at, chars=EVERY - {10})
        if c in "*+?{":
            raise Unreadable
        if c != "\\":
            return Node("chars", start, self.at, chars=self.literal(c))
        c = self.java[self.at : self.at + 1]
        self.at += 1
        if c in "bBAZG":
            return Node("zero", start, self.at)
        if c == "z":
            return Node("end", start, self.at)
        reference = re.compile(r"(?<=k)<\w+>|(?<=[1-9])\d*").match(self.java, self.at)
        if reference:
            self.at, self.doubt = reference.end(), True
            return Node("opaque", start, self.at)
        if c.lower() in ESCAPES:
            return Node("chars", start, self.at, chars=self.members(f"[\\{c}]"))
        if c in "tnrf":
            return Node("chars", start, self.at, chars=frozenset({ord({"t": "\t", "n": "\n", "r": "\r", "f": "\f"}[c])}))
        rest = re.compile(r"(?<=[pP])(?:\{[^}]*\}|\w)|(?<=x)(?:[0-9a-fA-F]{2}|\{[0-9a-fA-F]+\})|(?<=u)[0-9a-fA-F]{4}").match(self.java, self.at)
        if rest:
            self.at = rest.end()
            return Node("chars", start, self.at)
        if not c or c.isalnum():
            raise Unreadable
        return Node("chars", start, self.at, chars=self.literal(c))

    def literal(self, c: str) -> frozenset:
        if not c.isascii():
            return OTHERS
        same = {c, c.lower(), c.upper()} if self.fold else {c}
        return frozenset(map(ord, same)) | (OTHERS if self.fold and c.lower() in FOLDED else frozenset())

    def members(self, text: str) -> frozenset:
        """Characters of a class, or more than these."""
        inner = text[1:-1]
        unknown = "&&" in inner or re.search(r"(?<!\\)(?:\\\\)*\[|\\[^sdwSDWtnrf\W]", inner)
        if unknown:
            return EVERY
        try:
            test = re.compile(text, re.ASCII | (re.IGNORECASE if self.fold else 0))
        except re.error:
            return EVERY
        found = {i for i in range(128) if test.fullmatch(chr(i))}
        negated = inner.startswith("^")
        all_of: set = set()
        for c in re.findall(r"\\([sdwSDW])", inner):
            all_of |= ESCAPES[c] if c in ESCAPES else OTHERS - ESCAPES[c.lower()]
        some_of = OTHERS if not inner.isascii() or self.fold and any(chr(i).lower() in FOLDED for i in found) else all_of
        return frozenset(found | (OTHERS - all_of if negated else some_of))

    def bracket(self) -> Node:
        start, depth = self.at, 0
        while self.at < len(self.java):
            c = self.java[self.at]
            self.at += 2 if c == "\\" else 1
            depth += (c == "[") - (c == "]")
            if depth == 0:
                return Node("chars", start, self.at, chars=self.members(self.java[start : self.at]))
        raise Unreadable

    def group(self) -> Node:
        start = self.at
        opening = re.compile(r"\((?:\?(?:<[A-Za-z][A-Za-z0-9]*>|<?[=!]|[:>]|[dimsuU-]+[:)])|(?!\?))").match(self.java, start)
        if not opening:
            raise Unreadable
        self.at = opening.end()
        self.doubt |= bool(re.match(r"\(\?[a-zA-Z-]", opening.group()))
        if opening.group().endswith(")"):
            return Node("zero", start, self.at)
        inside = self.either()
        if not self.java.startswith(")", self.at):
            raise Unreadable
        self.at += 1
        look = opening.group()[-1] in "=!"
        mode = "<" if look and "<" in opening.group() else ""
        return Node("zero" if look else "group", start, self.at, [inside], mode=mode, quantifier=opening.end(), alone=look or opening.group() == "(?>")


def captured(java: str, node: Node) -> bool:
    opening = java[node.start : node.quantifier]
    return node.kind == "group" and (opening == "(" or opening.startswith("(?<"))


def captures(java: str, node: Node) -> bool:
    return captured(java, node) or any(captures(java, n) for n in node.inside)


def apart_from_last(java: str, node: Node) -> str | None:
    """A repeat that may be possessive as one whose last repetition alone has the groups; None where another repetition
    could be the last to set one of them, or where one has a repeat to be rewritten itself."""
    body, names = node.inside[0], []
    waiting = [(body, True)]
    while waiting:
        part, always = waiting.pop()
        if part.kind == "repeat" and part.high > FEW and part.mode != "+" and part.inside[0].kind == "group" and not part.inside[0].plain():
            return None
        if captured(java, part):
            if not always:
                return None
            names.append(part)
        waiting += [(n, always and part.kind in ("sequence", "group")) for n in part.inside]
    bare = text = java[body.start : body.end]
    for part in sorted(names, key=lambda n: -n.start):
        bare = bare[: part.start - body.start] + "(?:" + bare[part.quantifier - body.start :]
    count = f"{{{max(node.low - 1, 0)},{'' if node.high == FOREVER else int(node.high) - 1}}}+"
    return f"(?:(?>{bare})(?={bare})){count}{text}{'' if node.low else '?'}"


def as_class(java: str, body: Node, doubt: bool) -> str | None:
    """A group of alternatives of one character each as a class, in the same parentheses if these capture."""
    if body.kind != "group" or body.alone or body.inside[0].kind != "either":
        return None
    parts = []
    for branch in body.inside[0].inside:
        if len(branch.inside) != 1 or branch.inside[0].kind != "chars":
            return None
        text = java[branch.inside[0].start : branch.inside[0].end]
        if text == "." and doubt:
            return None
        parts.append("[^\\n]" if text == "." else "\\" + text if len(text) == 1 and text in "]^-&" else text)
    opening = java[body.start : body.quantifier]
    merged = "[" + "".join(parts) + "]"
    return merged if opening == "(?:" else f"{opening}{merged})"


@lru_cache(maxsize=4096)
def guarded(java: str) -> str:
    """The pattern with no repeat that could overflow a task's stack. Patterns that are not read stay as they are."""
    try:
        reader = Reader(java)
        tree = reader.whole()
    except Unreadable:
        return java
    changes: list[tuple[int, int, str]] = []
    bounded: list[tuple[Node, int]] = []

    def visit(node: Node, after: tuple[frozenset, bool], depth: int) -> None:
        if node.kind == "repeat":
            body = node.inside[0]
            inner = depth
            if node.high > FEW and node.mode != "+" and body.kind == "group" and not body.plain():
                merged = as_class(java, body, reader.doubt)
                if merged:
                    changes.append((body.start, body.end, merged))
                    return
                if not reader.doubt and keeps(node, after) and not captures(java, body):
                    changes.append((node.end - len(node.mode), node.end, "+"))
                elif not reader.doubt and keeps(node, after) and (apart := apart_from_last(java, node)):
                    changes.append((node.start, node.end, apart))
                    return
                else:
                    inner += 1
                    bounded.append((node, inner))
            visit(body, again(node, after), inner)
        elif node.kind == "either":
            for n in node.inside:
                visit(n, after, depth)
        else:
            # What a look behind finds has to end where it stands; a group that is left for good may end anywhere.
            after = (EVERY, False) if node.mode == "<" else (frozenset(), True) if node.alone else after
            for i, n in enumerate(node.inside):
                visit(n, followed(node.inside[i + 1 :], after), depth)

    visit(tree, (frozenset(), True), 0)
    if bounded:
        share = DEPTH / sum(n.steps() for n, _ in bounded)
        most = max(FEW, int(share ** (1 / max(depth for _, depth in bounded))))
        for node, _ in bounded:
            changes.append((node.quantifier, node.end, f"{{{node.low},{max(node.low, int(min(node.high, most)))}}}{node.mode}"))
    for start, end, text in sorted(changes, reverse=True):
        java = java[:start] + text + java[end:]
    return java
