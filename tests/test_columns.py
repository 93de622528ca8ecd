"""Edge cases of the column operators on literals."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import numbers as N
from lexmill.functions import sequence as S
from lexmill.operators import columns as G


def one(spark, column, data, kind="string"):
    return spark.createDataFrame([(data,)], f"s {kind}").select(column.alias("v")).first()[0]


def value(spark, rule, data, kind="string"):
    got = one(spark, G.parse_prefix(rule, F.col("s")), data, kind)
    return got and (got["value"], got["position"])


def test_sequences(spark):
    assert one(spark, S.at(F.col("s"), -1), "abc") == "c"
    assert one(spark, S.at(F.col("s"), 3), "abc") is None
    assert one(spark, S.slice_(F.col("s"), 1, 9), "abc") is None
    assert one(spark, S.index_of(F.col("s"), "b", 2), "abcb") == 3
    assert one(spark, S.index_of(F.col("s"), b"\x02"), bytearray(b"\x01\x02"), "binary") == 1
    assert one(spark, S.utf16_length(F.col("s")), "a\U0001f600") == 3


@pytest.mark.parametrize(
    ("rule", "data", "expected"),
    [
        (G.exact("ab"), "abc", ("ab", 2)), (G.exact("ab"), "a", None), (G.fixed(3), "ab", None), (G.fixed(0), "ab", ("", 0)),
        (G.end_of_input(), "", (None, 0)), (G.end_of_input(), "x", None),
        (G.terminated(";"), "a;b", ("a", 2)), (G.terminated(";", False), "a;b", ("a", 1)), (G.terminated(";"), "ab", None),
        (G.terminated_pieces(";"), "a;;b;", (["a", "", "b"], 5)), (G.terminated_pieces(";"), "", ([], 0)), (G.terminated_pieces(";"), "a;b", None),
        (G.separated("[0-9]+", ","), "1,22,x", (["1", "22"], 4)), (G.separated("[0-9]+", ","), "x", ([], 0)), (G.separated("[0-9]+", ",", 1), "x", None), (G.separated("[0-9]+", ","), ",1", ([], 0)),
        (G.many("ab|c"), "abcabx", (["ab", "c", "ab"], 5)), (G.many("a"), "", ([], 0)), (G.many("a", 1), "b", None),
        (G.optional(G.exact("a")), "b", (None, 0)), (G.lookahead(G.exact("a")), "ab", ("a", 0)), (G.negative_lookahead(G.exact("a")), "ab", None),
        (G.first_of([G.exact("ab"), G.exact("a")]), "ac", ("a", 1)), (G.exclusive([G.exact("b"), G.exact("a")]), "ac", ("a", 1)), (G.exclusive([G.exact("b")]), "ac", None),
        (G.slice_bounded(G.exact("a"), 2), "abc", None), (G.slice_bounded(G.exact("ab"), 2), "abc", ("ab", 2)),
        (G.terminated_array("[a-c]", "!"), "ab!c", ((["a", "b"], "!"), 3)), (G.quantifier(G.fixed(2), 2, 2), "abcde", (["ab", "cd"], 4)), (G.quantifier(G.fixed(2), 3, 2), "abcde", None),
        (G.regex("x*"), "ab", ("", 0)), (G.skip(2), "abc", (None, 2)),
    ],
)
def test_rules(spark, rule, data, expected):
    got = value(spark, rule, data)
    assert got == expected if expected is None or not hasattr(got[0], "asDict") else (tuple(got[0]), got[1]) == expected


def test_null_input(spark):
    assert value(spark, G.exact("a"), None) is None


def test_long_input(spark):
    assert value(spark, G.separated("[a-z]+", " "), "word " * 100_000)[1] == 499_999


def test_ambiguity_stops(spark):
    with pytest.raises(Exception, match="more than one alternative"):
        value(spark, G.exclusive([G.exact("a"), G.exact("ab")]), "abc")


def test_object_drops_hidden_fields(spark):
    got = value(spark, G.object_({"a": G.fixed(1), "_b": G.fixed(1), "c": G.fixed(1), "k": 7}), "xyz!")
    assert got[0].asDict() == {"a": "x", "c": "z", "k": 7} and got[1] == 3


def test_strict(spark):
    assert one(spark, G.parse(G.exact("a"), F.col("s")), "ab") is None
    with pytest.raises(Exception, match="input remains"):
        one(spark, G.parse_strict(G.exact("a"), F.col("s")), "ab")


@pytest.mark.parametrize(("data", "unsigned", "signed", "used"), [(b"\x00", 0, 0, 1), (b"\xe5\x8e\x26", 624485, 624485, 3), (b"\x7f", 127, -1, 1), (b"\xff" * 9 + b"\x01", 2**64 - 1, None, 10), (b"\x80", None, None, None)])
def test_leb128(spark, data, unsigned, signed, used):
    u = one(spark, N.uleb128(F.col("s")), bytearray(data), "binary")
    assert u is None if unsigned is None else (int(u["value"]), u["length"]) == (unsigned, used)
    if signed is not None:
        assert int(one(spark, N.sleb128(F.col("s")), bytearray(data), "binary")["value"]) == signed


@pytest.mark.parametrize("width", [1, 2, 4, 8])
@pytest.mark.parametrize("little", [True, False])
def test_integers(spark, width, little):
    for v in (0, 1, 2 ** (8 * width - 1), 2 ** (8 * width) - 1):
        raw = bytearray(v.to_bytes(width, "little" if little else "big"))
        assert int(one(spark, N.uint(F.col("s"), 0, width, little), raw, "binary")) == v
        assert one(spark, N.sint(F.col("s"), 0, width, little), raw, "binary") == int.from_bytes(raw, "little" if little else "big", signed=True)
    assert one(spark, N.uint(F.col("s"), 1, width, little), bytearray(width), "binary") is None


def test_values_only(spark):
    v = lambda p, x: one(spark, G.parse_value(p, F.col("s")), x)
    assert v(G.fixed(2), "abc") == "ab" and v(G.fixed(2), "a") is None and v(G.fixed(0), "") == "" and v(G.fixed(1), None) is None
    assert v(G.terminated("."), "a.b") == "a" and v(G.terminated("."), "ab") is None and v(G.terminated("."), ".") == "" and v(G.terminated("é"), "añé") == "añ"
    assert one(spark, S.index_of(F.col("s"), ""), "abc") == 0 and one(spark, S.rest_from(F.col("s"), 9), "abc") == "" and one(spark, S.rest_from(F.col("s"), 1), "abc") == "bc"
    assert bytes(one(spark, S.rest_from(F.col("s"), 1), bytearray(b"\xff\xfe\x00"), "binary")) == b"\xfe\x00"
    assert one(spark, S.index_of(F.col("s"), b"\x02"), bytearray(b"\xff\x02"), "binary") == 1
