"""The query syntax: a query's text becomes a boolean tree, one small helper for each query.

    words            any of them
    "a phrase"       its words on end ('...' too)
    a AND b, a OR b  AND binds closer; words side by side are joined by OR
    +a  -a  NOT a    demanded, ruled out
    (a b)            a group
    project:a        another field: project and id hold one exact value, document is the text
    field:(a b)      a group of one field
    a^2              a part of the score that counts so many times

A text that isn't well formed (open quotes or groups, an unknown field, an operator without a
side, only words that are ruled out, more than ``DEEPEST`` groups within each other) isn't
syntax but plain words; so are texts with ranges, sets, or a bare ``*``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FIELDS = ("document", "project", "id")
#: Names of the text field.
DEFAULT = "document"
DEEPEST = 30
MUST, SHOULD, NOT = "must", "should", "not"
_WORD = re.compile(r"""[^\s+^`:{}"'\[\]()!\\*-][^\s^:{}"'\[\]()\\]*""")
_FIELD = re.compile(r"([A-Za-z_][\w.-]*):")
_BOOST = re.compile(r"\^(\d+(?:\.\d+)?)")


class Malformed(ValueError):
    """The text isn't of the syntax."""


@dataclass
class Node:
    """A leaf (``text`` of a ``field``) or a group of children with their roles."""

    children: list[tuple[str, Node]] = field(default_factory=list)
    text: str | None = None
    field: str = DEFAULT
    boost: float = 1.0


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def spaces(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def takes(self, word: str) -> bool:
        """Whether a word of capitals stands here on its own; it is read then."""
        end = self.at + len(word)
        if self.text.startswith(word, self.at) and (end == len(self.text) or self.text[end].isspace() or self.text[end] == "("):
            self.at = end
            self.spaces()
            return True
        return False

    def group(self, of: str, depth: int) -> Node:
        """Clauses up to the end or a closing bracket."""
        if depth > DEEPEST:
            raise Malformed("too deep")
        chains: list[list[tuple[str, Node]]] = []
        joined = False
        self.spaces()
        while self.at < len(self.text) and self.text[self.at] != ")":
            if chains and not joined:
                if self.takes("AND"):
                    chains[-1].append(self.clause(of, depth))
                    self.spaces()
                    continue
                self.takes("OR")
            chains.append([self.clause(of, depth)])
            self.spaces()
        parts = [chain[0] if len(chain) == 1 else (SHOULD, Node([(MUST if role == SHOULD else role, n) for role, n in chain])) for chain in chains]
        return parts[0][1] if len(parts) == 1 and parts[0][0] == SHOULD else Node(parts)

    def clause(self, of: str, depth: int) -> tuple[str, Node]:
        """One part with its role."""
        if self.at >= len(self.text):
            raise Malformed("a side is missing")
        role = SHOULD
        if self.takes("NOT"):
            role = NOT
        elif self.text[self.at] in "+-":
            role = MUST if self.text[self.at] == "+" else NOT
            self.at += 1
        for word in ("AND", "OR", "NOT", "IN"):
            if self.takes(word):
                raise Malformed("a side is missing")
        return role, self.boosted(self.primary(of, depth))

    def boosted(self, node: Node) -> Node:
        found = _BOOST.match(self.text, self.at)
        if found:
            self.at = found.end()
            return Node([(MUST, node)], boost=float(found[1]))
        return node

    def primary(self, of: str, depth: int) -> Node:
        if self.at >= len(self.text):
            raise Malformed("a side is missing")
        sign = self.text[self.at]
        if sign == "(":
            self.at += 1
            node = self.group(of, depth + 1)
            if self.at >= len(self.text):
                raise Malformed("an open group")
            self.at += 1
            return node
        if sign in "\"'":
            end = self.text.find(sign, self.at + 1)
            if end < 0:
                raise Malformed("an open quote")
            node = Node(text=self.text[self.at + 1 : end], field=of)
            self.at = end + 1
            return node
        named = _FIELD.match(self.text, self.at)
        if named:
            if named[1] not in FIELDS:
                raise Malformed("an unknown field")
            self.at = named.end()
            return self.primary(named[1], depth)
        word = _WORD.match(self.text, self.at)
        if not word:
            raise Malformed("an odd sign")
        self.at = word.end()
        return Node(text=word[0], field=of)


def parse(text: str) -> Node | None:
    """The tree of a query; None if its text isn't of the syntax."""
    reader = _Reader(text)
    try:
        root = reader.group(DEFAULT, 0)
    except Malformed:
        return None
    if reader.at < len(text) or (root.text is None and all(role == NOT for role, _ in root.children)):
        return None
    return root


def rows(text: str | None) -> list[tuple[int, int, int, str, float, str | None, str | None]]:
    """(node, parent, depth, role, boost, field, text) of a query's tree, the root first; empty if it isn't syntax."""
    root = parse(text or "")
    if root is None:
        return []
    out: list[tuple[int, int, int, str, float, str | None, str | None]] = []
    left = [(root, -1, 0, SHOULD)]
    while left:
        node, parent, depth, role = left.pop()
        number = len(out)
        out.append((number, parent, depth, role, node.boost, node.field if node.text is not None else None, node.text))
        left.extend((child, number, depth + 1, r) for r, child in reversed(node.children))
    return out
