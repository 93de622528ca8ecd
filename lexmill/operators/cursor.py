"""A cursor over one input, for formats whose recursion no column expression can hold. It runs inside Arrow batches."""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class ParseFailure(Exception):
    """A recoverable failure: the input isn't of the grammar."""

    name: str
    message: str
    position: int
    depth: int = 0

    def __str__(self) -> str:
        return f"{self.name} at {self.position}: {self.message}"


#: Frames that a rule may use: some thousands of levels of nesting in every format. What is deeper fails as TooDeep.
FRAMES = 150_000


class GrammarError(Exception):
    """The grammar itself is wrong; never recovered from."""


class Cursor:
    """Position in a string or bytes, bounded by an end; remembers how far any attempt has looked."""

    def __init__(self, data: str | bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at, self.end = data, at, len(data) if end is None else end
        self.furthest, self.depth = at, 0

    def peek(self, n: int = 1):  # noqa: ANN201
        """The next n elements, fewer at the end."""
        stop = min(self.at + n, self.end)
        self.furthest = max(self.furthest, stop)
        return self.data[self.at : stop]

    def fail(self, name: str, message: str) -> ParseFailure:
        return ParseFailure(name, message, self.at, self.depth)

    def take(self, n: int):  # noqa: ANN201
        got = self.peek(n)
        if len(got) < n:
            raise self.fail("UnexpectedEnd", f"{n} elements wanted, {len(got)} left")
        self.at += n
        return got

    def done(self) -> bool:
        return self.at >= self.end

    def starts(self, what: str | bytes) -> bool:
        return self.peek(len(what)) == what

    def accept(self, what: str | bytes) -> bool:
        if self.starts(what):
            self.at += len(what)
            return True
        return False

    def expect(self, what: str | bytes) -> None:
        if not self.accept(what):
            raise self.fail("Unexpected", f"{what!r} wanted, {self.peek(len(what))!r} found")

    def match(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.data, self.at, self.end)
        if m:
            self.at = m.end()
            self.furthest = max(self.furthest, self.at)
        return m

    def until(self, what: bytes | str, use: bool = True):  # noqa: ANN201
        i = self.data.find(what, self.at, self.end)
        if i < 0:
            raise self.fail("Unterminated", f"no {what!r} follows")
        out, self.at = self.data[self.at : i], i + (len(what) if use else 0)
        return out

    def number(self, width: int, order: str = "little", signed: bool = False) -> int:
        return int.from_bytes(self.take(width), order, signed=signed)

    def inner(self, n: int) -> Cursor:
        """A cursor over the next n elements, which are used up here."""
        if self.at + n > self.end:
            raise self.fail("UnexpectedEnd", f"a slice of {n} elements wanted")
        out = Cursor(self.data, self.at, self.at + n)
        out.depth, self.at = self.depth + 1, self.at + n
        return out

    def attempt(self, rule: Callable[[Cursor], object]) -> tuple[bool, object]:
        """(True, value), or (False, failure) with the position as before."""
        at = self.at
        try:
            self.depth += 1
            return True, rule(self)
        except ParseFailure as e:
            self.at = at
            return False, e
        finally:
            self.depth -= 1

    def first(self, *rules: Callable[[Cursor], object]):  # noqa: ANN201
        """Ordered choice; of the failures that join_failures keeps (here: those that got furthest) the first is raised."""
        failures: list[ParseFailure] = []
        for p in rules:
            ok, got = self.attempt(p)
            if ok:
                return got
            failures.append(got)
        raise join_failures(failures, "furthest")[0]

    def repeat(self, rule: Callable[[Cursor], object]) -> list:
        """As often as it succeeds; an empty success stops and doesn't count."""
        out = []
        while True:
            at = self.at
            ok, got = self.attempt(rule)
            if not ok or self.at == at:
                self.at = at
                return out
            out.append(got)


def join_failures(failures: list[ParseFailure], mode: str = "all") -> list[ParseFailure]:
    """Which failures of several alternatives are reported: none of them, all, or those that got furthest or deepest (ties stay)."""
    if mode == "none" or not failures:
        return []
    if mode == "all":
        return failures
    key = {"furthest": lambda f: f.position, "deepest": lambda f: f.depth}[mode]
    most = max(map(key, failures))
    return [f for f in failures if key(f) == most]


def run(rule: Callable[[Cursor], object], data: str | bytes, partial: bool = False):  # noqa: ANN201
    """The value of the whole input; with partial (value, position). Whatever the input, only a ParseFailure is raised.

    Values that no number, date or text can hold fail as Malformed, nesting beyond FRAMES as TooDeep.
    """
    c, before = Cursor(data), sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, FRAMES))
    try:
        value = rule(c)
    except RecursionError:
        raise ParseFailure("TooDeep", "less nesting wanted", c.at, c.depth) from None
    except (ValueError, OverflowError, LookupError, struct.error) as e:
        raise ParseFailure("Malformed", f"{type(e).__name__}: {e}", c.at, c.depth) from e
    finally:
        sys.setrecursionlimit(before)
    if partial:
        return value, c.at
    if not c.done():
        raise ParseFailure("UnexpectedRemainingInput", f"{c.end - c.at} elements remain", c.at)
    return value
