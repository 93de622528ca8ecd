"""Grammar operators over columns.

A rule is a function from the input that is left (a string or binary column) to struct(value, used), or null where it
fails. Operators compose such functions, and the whole grammar is one native expression; nothing leaves the JVM. Shared
parts are bound once, by a transform of one element, so an expression stays linear in the grammar's size; such a binding
is interpreted, not compiled, and a predicate on a grammar's result isn't pushed to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import uint
from ..functions.sequence import as_column, index_of, let, rest_from, slice_, starts_with

Rule = Callable[[Column], Column]


def result(value: Column, used: Column) -> Column:
    return F.struct(value.alias("value"), used.cast("int").alias("used"))


def _when(test: Column, value: Column, used: Column) -> Column:
    return F.when(test, result(value, used))


# elements and fixed sequences


def element() -> Rule:
    """Any one element; fails at the end of the input."""
    return lambda s: _when(F.length(s) > 0, F.substring(s, 1, 1), F.lit(1))


def predicate_element(test: Callable[[Column], Column]) -> Rule:
    """One element that satisfies test."""
    return lambda s: let(F.substring(s, 1, 1), lambda e: _when((F.length(s) > 0) & F.coalesce(test(e), F.lit(False)), e, F.lit(1)))


def exact(sequence: str | bytes) -> Rule:
    """This element or sequence."""
    return lambda s: _when(starts_with(s, sequence), F.lit(sequence), F.lit(len(sequence)))


def fixed(n: Column | int) -> Rule:
    """Exactly n elements; a negative n is an error of the grammar."""
    if isinstance(n, int) and n < 0:
        raise ValueError("a length is at least 0")
    if isinstance(n, int):
        return lambda s: _when(F.length(s) >= n, F.substring(s, 1, n), F.lit(n))
    return lambda s: let(slice_(s, 0, n), lambda v: _when(v.isNotNull(), v, n))


def skip(n: Column | int) -> Rule:
    """Passes over n elements without a value; may run past the end."""
    if isinstance(n, int) and n < 1:
        raise ValueError("skip needs a positive length")
    return lambda s: result(F.lit(None).cast("string"), as_column(n))


def skip_to(at: Column | int, place: Column | int) -> Rule:
    """Passes over what is before position `place` of the whole input, of which `at` elements are used; never goes back."""
    at, place = as_column(at), as_column(place)
    return lambda s: F.when((place >= at) & (place - at <= F.length(s)), result(F.lit(None).cast("string"), place - at))


def end_of_input() -> Rule:
    return lambda s: _when(F.length(s) == 0, F.lit(None).cast("string"), F.lit(0))


def slice_bounded(p: Rule, n: Column | int, all_of_it: bool = True) -> Rule:
    """p sees the next n elements only and, unless told otherwise, must use them all."""
    return lambda s: let(slice_(s, 0, n), lambda part: let(p(part), lambda r: F.when(part.isNotNull() & (r["used"] == as_column(n) if all_of_it else r.isNotNull()), r)))


def consumed(p: Rule) -> Rule:
    """struct(value, raw): p's value and the piece of input it used."""
    return lambda s: let(p(s), lambda r: F.when(r.isNotNull(), result(F.struct(r["value"].alias("value"), F.substring(s, F.lit(1), r["used"]).alias("raw")), r["used"])))


def regex(pattern: str, group: int = 0) -> Rule:
    """A match at the very start of the input; an empty match is a match."""
    anchored = rf"\A(?:{pattern})"
    return lambda s: _when(F.regexp_like(s, F.lit(anchored)), F.regexp_extract(s, anchored, group), F.length(F.regexp_extract(s, anchored, 0)))


# terminated and separated sequences


def terminated(end: str | bytes, take_end: bool = True) -> Rule:
    """What comes before the first end, which is used up unless told otherwise; fails without one."""

    def rule(s: Column) -> Column:
        i = index_of(s, end)  # compiled code finds it once
        return _when(i >= 0, F.substring(s, F.lit(1), i), i + (len(end) if take_end else 0))

    return rule


def terminated_pieces(end: str) -> Rule:
    """All pieces that end with `end`, to the end of the input; empty pieces stay; an unterminated tail fails."""
    return lambda s: let(F.split(s, _quoted(end), -1), lambda a: _when((F.length(s) == 0) | F.endswith(s, F.lit(end)), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.length(s)))


def _quoted(text: str) -> str:
    return rf"\Q{text}\E" if r"\E" not in text else "".join("\\" + c if not c.isalnum() else c for c in text)


def pieces(separator: str) -> Rule:
    """All pieces between a literal separator, to the end of the input; empty pieces stay, so there is one at least."""
    return lambda s: F.when(s.isNotNull(), result(F.split(s, _quoted(separator), -1), F.length(s)))


def regex_groups(pattern: str, groups: int) -> Rule:
    """A match at the very start of the input as an array: the whole match, then each group ('' where it takes no part)."""
    anchored = rf"\A(?:{pattern})"
    return lambda s: _when(F.regexp_like(s, F.lit(anchored)), F.array(*(F.regexp_extract(s, anchored, g) for g in range(groups + 1))), F.length(F.regexp_extract(s, anchored, 0)))


def separated(item: str, separator: str, least: int = 0) -> Rule:
    """Items (a regular expression) with separators between; a separator at the end isn't used. least: 0 or 1."""
    step = rf"(?:\A|(?!\A)\G(?:{separator}))({item})"  # each match begins where the last one ended: no recursion, whatever the length
    return lambda s: let(F.regexp_extract_all(s, F.lit(step), F.lit(0)), lambda a: _when(F.size(a) >= least, F.regexp_extract_all(s, F.lit(step), F.lit(1)), F.length(F.array_join(a, ""))))


def many(item: str, least: int = 0) -> Rule:
    """Repetitions of a regular expression, as many as follow one another; empty matches stop and don't count."""
    return lambda s: let(F.regexp_extract_all(s, F.lit(rf"\G(?:{item})"), F.lit(0)), lambda a: let(F.filter(a, lambda x: x != ""), lambda v: _when(F.size(v) >= least, v, F.length(F.array_join(v, "")))))


def terminated_array(item: str, end: str) -> Rule:
    """struct(items, end): items up to the first place where end matches."""
    step = rf"\G(?!{end})(?:{item})"

    def run(s: Column) -> Column:
        items = F.filter(F.regexp_extract_all(s, F.lit(step), F.lit(0)), lambda x: x != "")
        return let(items, lambda a: let(F.length(F.array_join(a, "")), lambda n: let(F.regexp_substr(rest_from(s, n), F.lit(rf"\A(?:{end})")), lambda e: _when(e.isNotNull(), F.struct(a.alias("items"), e.alias("end")), n + F.length(e)))))

    return run


# repetition of any rule


def _loop(s: Column, p: Rule, step: Callable[[Column, Column], Column], at: Column | int = 0) -> Column:
    """struct(values, at, done) after as many steps as the input has elements; step(state, p's result there) says what is next."""
    none = F.slice(F.transform(F.array(p(s)), lambda r: r["value"]), 1, 0)
    start = F.struct(none.alias("values"), as_column(at).cast("int").alias("at"), F.lit(False).alias("done"))
    once = lambda acc, _: F.when(acc["done"], acc).otherwise(let(p(rest_from(s, acc["at"])), lambda r: step(acc, r)))
    return F.aggregate(F.sequence(F.lit(0), F.length(s)), start, once)


def _state(values: Column, at: Column, done: Column | bool) -> Column:
    return F.struct(values.alias("values"), at.cast("int").alias("at"), as_column(done).alias("done"))


def array_of(p: Rule, least: int = 0) -> Rule:
    """p as often as it succeeds, as an array of its values; a success that uses nothing stops and doesn't count."""
    go = lambda acc, r: F.when(F.coalesce(r["used"], F.lit(0)) > 0, _state(F.array_append(acc["values"], r["value"]), acc["at"] + r["used"], False)).otherwise(_state(acc["values"], acc["at"], True))
    return lambda s: let(_loop(s, p, go), lambda a: _when(F.size(a["values"]) >= least, a["values"], a["at"]))


def separated_by(p: Rule, separator: Rule, least: int = 0) -> Rule:
    """Values of p with a separator between each two; a separator that no p follows isn't used."""
    rest = bind_second(separator, p)
    go = lambda acc, r: F.when(F.coalesce(r["used"], F.lit(0)) > 0, _state(F.array_append(acc["values"], r["value"]), acc["at"] + r["used"], False)).otherwise(_state(acc["values"], acc["at"], True))

    def run(s: Column) -> Column:
        first = p(s)
        more = lambda f: let(_loop(s, rest, go, f["used"]), lambda a: result(F.concat(F.array(f["value"]), a["values"]), a["at"]))
        empty = result(F.slice(F.transform(F.array(first), lambda r: r["value"]), 1, 0), F.lit(0)) if least == 0 else F.lit(None)
        return let(first, lambda f: F.when(f.isNotNull(), more(f)).otherwise(empty))

    return run


def bind_second(first: Rule, second: Rule) -> Rule:
    """first, then second; the value is the second's."""
    return bind(first, lambda _: second)


def array_until(p: Rule, end: Rule, checked: bool = True) -> Rule:
    """struct(items, end): values of p up to the first place where end succeeds. Checked: both succeeding there stops the query."""

    def run(s: Column) -> Column:
        both = lambda x: F.struct(p(x).alias("item"), end(x).alias("end"))
        none = F.slice(F.transform(F.array(p(s)), lambda r: r["value"]), 1, 0)
        start = _state(none, F.lit(0), False)

        def step(acc: Column, r: Column) -> Column:
            item = F.when(F.coalesce(r["item"]["used"], F.lit(0)) > 0, _state(F.array_append(acc["values"], r["item"]["value"]), acc["at"] + r["item"]["used"], False)).otherwise(_state(acc["values"], F.lit(-1), True))
            found = F.when(r["end"].isNotNull(), _state(acc["values"], acc["at"], True))
            if checked:
                found = F.when(r["end"].isNotNull() & r["item"].isNotNull(), F.raise_error(F.lit("both an item and the end of the array match"))).when(r["end"].isNotNull(), _state(acc["values"], acc["at"], True))
            return found.otherwise(item)

        loop = F.aggregate(F.sequence(F.lit(0), F.length(s)), start, lambda acc, _: F.when(acc["done"], acc).otherwise(let(both(rest_from(s, acc["at"])), lambda r: step(acc, r))))
        close = lambda a, e: F.when(e.isNotNull(), result(F.struct(a["values"].alias("items"), e["value"].alias("end")), a["at"] + e["used"]))
        return let(loop, lambda a: F.when(a["done"] & (a["at"] >= 0), let(end(rest_from(s, a["at"])), lambda e: close(a, e))))

    return run


def prefixed(width: int, little: bool = True) -> Rule:
    """Bytes behind their count, an unsigned integer of so many bytes."""
    return lambda s: let(uint(s, 0, width, little), lambda n: let(slice_(s, F.lit(width), n + width), lambda v: _when(v.isNotNull(), v, n + width)))


# structure


def tuple_(rules: Sequence[Rule]) -> Rule:
    """Values in sequence as struct(_1, _2, ...)."""
    return object_({f"_{i + 1}": p for i, p in enumerate(rules)})


def object_(fields: Mapping[str, object]) -> Rule:
    """A record: rules run in order of the keys; what isn't a rule is a constant; keys that begin with _ are parsed and left out (but not _1, _2 ... of tuples)."""
    names = [k for k, v in fields.items() if callable(v)]
    shown = [k for k in fields if not k.startswith("_") or k[1:].isdigit()]

    def run(s: Column) -> Column:
        def go(left: list[str], at: Column, got: dict[str, Column]) -> Column:
            if not left:
                values = [(got[k] if k in got else as_column(fields[k])).alias(k) for k in shown]
                return result(F.struct(*values) if values else F.lit(None).cast("string"), at)
            name = left[0]
            return let(fields[name](rest_from(s, at)), lambda r: F.when(r.isNotNull(), go(left[1:], at + r["used"], got | {name: r["value"]})))

        return go(names, F.lit(0), {})

    return run


def mapped(p: Rule, f: Callable[[Column], Column]) -> Rule:
    return lambda s: let(p(s), lambda r: F.when(r.isNotNull(), result(f(r["value"]), r["used"])))


def bind(p: Rule, make: Callable[[Column], Rule]) -> Rule:
    """The second rule depends on the first's value: length prefixes and the like. The value is the second's."""
    return lambda s: let(p(s), lambda a: F.when(a.isNotNull(), let(make(a["value"])(rest_from(s, a["used"])), lambda b: F.when(b.isNotNull(), result(b["value"], a["used"] + b["used"])))))


def quantifier(p: Rule, n: Column | int, width: int) -> Rule:
    """Exactly n times a rule of fixed width, as an array."""

    def run(s: Column) -> Column:
        count = as_column(n)
        parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: p(slice_(s, i * width, (i + 1) * width))))
        return let(parts, lambda a: F.when(F.coalesce(count == 0, F.lit(False)), result(F.slice(F.transform(F.array(p(s)), lambda r: r["value"]), 1, 0), F.lit(0))).when(F.forall(a, lambda r: r.isNotNull() & (r["used"] == width)), result(F.transform(a, lambda r: r["value"]), count * width)))

    return run


# choice, option, looking ahead


def first_of(rules: Sequence[Rule]) -> Rule:
    """Ordered choice: the first that succeeds."""
    return lambda s: F.coalesce(*(p(s) for p in rules))


def exclusive(rules: Sequence[Rule]) -> Rule:
    """Exclusive choice: none of them is a failure, more than one an error of the grammar, which stops the query."""

    def run(s: Column) -> Column:
        every = F.filter(F.array(*(p(s) for p in rules)), lambda r: r.isNotNull())
        return let(every, lambda a: F.when(F.size(a) == 1, F.element_at(a, 1)).when(F.size(a) > 1, F.raise_error(F.lit("more than one alternative of an exclusive choice matches"))))

    return run


def switch(arms: Mapping[str, Rule], default: Rule | None = None) -> Rule:
    """The rule for the next element, which isn't used by the choice itself."""

    def run(s: Column) -> Column:
        first = F.substring(s, 1, 1)
        out = F.when(F.lit(False), F.lit(None))
        for i, (key, p) in enumerate(arms.items()):
            out = F.when(first == key, p(s)) if i == 0 else out.when(first == key, p(s))
        return out.otherwise(default(s)) if default else out

    return run


def optional(p: Rule) -> Rule:
    """p, or a null value without using anything."""
    return lambda s: let(p(s), lambda r: result(r["value"], F.coalesce(r["used"], F.lit(0))))


def lookahead(p: Rule) -> Rule:
    """p's value, but nothing is used."""
    return lambda s: let(p(s), lambda r: F.when(r.isNotNull(), result(r["value"], F.lit(0))))


def negative_lookahead(p: Rule) -> Rule:
    """Succeeds, using nothing, where p fails."""
    return lambda s: F.when(p(s).isNull(), result(F.lit(None).cast("string"), F.lit(0)))


# running a rule


def parse(p: Rule, s: Column) -> Column:
    """The value if p uses the whole input, else null."""
    return let(p(s), lambda r: F.when(r["used"] >= F.length(s), r["value"]))


def parse_prefix(p: Rule, s: Column) -> Column:
    """struct(value, position, remaining), null where p fails."""
    return let(p(s), lambda r: F.when(r.isNotNull(), F.struct(r["value"].alias("value"), r["used"].alias("position"), rest_from(s, r["used"]).alias("remaining"))))


def parse_value(p: Rule, s: Column) -> Column:
    """The value, whatever follows, null where p fails; what remains isn't built."""
    return p(s)["value"]


def parse_strict(p: Rule, s: Column) -> Column:
    """As parse, but a failure stops the query."""
    return let(p(s), lambda r: F.when(r["used"] >= F.length(s), r["value"]).when(r.isNotNull(), F.raise_error(F.lit("input remains"))).otherwise(F.raise_error(F.lit("the input doesn't parse"))))
