"""A stream of tokens over a cursor's input, for programming languages; failures point into the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from .cursor import Cursor, ParseFailure


class Tokens:
    """Tokens of a text by a pattern whose groups name their kinds; the group `skip` is left out.

    Position, choice and repetition work on tokens; `at` may be set back at any time. The last kind is "end".
    """

    def __init__(self, c: Cursor, pattern: re.Pattern) -> None:
        self.cursor, self.at, self.depth = c, 0, 0
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.places: list[int] = []
        i = c.at
        while i < c.end:
            kind, end = self.token(pattern, i)
            if end == i:
                raise ParseFailure("Unexpected", f"no token begins with {c.data[i]!r}", i)
            if kind != "skip":
                self.kinds.append(kind)
                self.texts.append(c.data[i:end])
                self.places.append(i)
            i = end
        self.kinds.append("end")
        self.texts.append("")
        self.places.append(c.end)
        self.worst: ParseFailure | None = None

    def token(self, pattern: re.Pattern, i: int) -> tuple[str, int]:
        """Kind and end of the token at i, the same i if there is none. Languages whose tokens depend on those before override this."""
        m = pattern.match(self.cursor.data, i, self.cursor.end)
        return (m.lastgroup, m.end()) if m else ("", i)

    @property
    def kind(self) -> str:
        return self.kinds[self.at]

    @property
    def text(self) -> str:
        return self.texts[self.at]

    def ahead(self, n: int = 1) -> str:
        return self.texts[min(self.at + n, len(self.texts) - 1)]

    def joined(self, n: int = 1) -> bool:
        """Whether the token n further stands directly after the one before it."""
        i = self.at + n
        return i < len(self.texts) and self.places[i - 1] + len(self.texts[i - 1]) == self.places[i]

    def fail(self, wanted: str) -> ParseFailure:
        f = ParseFailure("Unexpected", f"{wanted} wanted, {self.text!r} found", self.places[self.at], self.depth)
        if self.worst is None or f.position > self.worst.position:
            self.worst = f
        return f

    def take(self, kind: str) -> str:
        if self.kind != kind:
            raise self.fail(kind)
        self.at += 1
        return self.texts[self.at - 1]

    def accept(self, *texts: str) -> str:
        """The next token's text if it is one of these, else the empty text."""
        if self.text in texts and self.kind in ("word", "mark"):
            self.at += 1
            return self.texts[self.at - 1]
        return ""

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise self.fail(repr(text))

    def attempt(self, rule: Callable[[], object]):  # noqa: ANN201
        """The rule's value, or None with the position as before."""
        at = self.at
        try:
            return rule()
        except ParseFailure:
            self.at = at
            return None

    def separated(self, item: Callable[[], object], close: str, mark: str = ",", trailing: bool = True) -> list:
        """Items with marks between them, and after the last if trailing says so; uses up the closing token."""
        out: list = []
        while not self.accept(close):
            out.append(item())
            if not self.accept(mark):
                self.expect(close)
                break
            if not trailing and self.text == close:
                raise self.fail("an item")
        return out

    @contextmanager
    def nested(self, most: int = 5000) -> Iterator[None]:
        """Depth of recursion, bounded by `most` levels."""
        self.depth += 1
        try:
            if self.depth > most:
                raise self.fail("less nesting")
            yield
        finally:
            self.depth -= 1

    def whole(self, rule: Callable[[], object]):  # noqa: ANN201
        """The rule's value of all tokens; else the failure that got furthest."""
        try:
            value = rule()
            if self.kind != "end":
                raise self.fail("end of text")
        except ParseFailure as e:
            raise self.worst or e from None
        self.cursor.at = self.cursor.end
        return value
