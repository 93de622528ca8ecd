"""Programming languages: trees of what the grammars cover, printing and parsing again, failures."""

import json

import pytest

from lexmill.operators.cursor import ParseFailure, run
from lexmill.sources import java, java_text, javascript, javascript_text, smali, tables, zig, zig_text

JAVA = r"""
@A package a.b.c; import java.util.*; import static x.Y.z;
/** doc */
@Foo(value = 1, names = {"a", "b"}) @Bar("x") @Baz
public abstract sealed class C<T extends Comparable<T> & Runnable, U> extends D<Map<String, List<? super T>>> implements E, F.G<int[]> permits H {
  private static final int[] A[] = {1, 2, {3}}, B = new int[]{4};
  static { int x = 0x1FL + 1.5e3f + 'c' + .5; }
  { foo(); }
  public C(final int a, @N String... rest) throws IOException, X { super(a); this.x = a; }
  <R> R m(C<T> this, R r) { return r; }
  abstract void q();
  void body() {
    for (int i = 0, j = 1; i < 10 && j >> 2 >= 3; i++, --j) { continue; }
    for (final String s : list) if (s instanceof String t && !t.isEmpty()) break; else { }
    for (;;) ;
    while (true) do x += 1; while (x < 3);
    outer: try (var r = open(); s) { throw new E("m", e); } catch (A | B e) { } finally { }
    switch (x) { case 1: case 2: y(); break; default: z(); }
    int v = switch (y) { case A, B -> 1; case Point(int a, var b) when a > b -> { yield 2; } default -> throw new X(); };
    Runnable r = () -> {}; F<A, B> f = (a, b) -> a + b; G g = x -> x; H h = (int q) -> (long) q;
    foo(String::valueOf, int[]::new, List<String>::new, this::bar, Foo.class, int[].class);
    a.<String>b(1).c[2] = (String) (Object) d ? e : f -> g;
    synchronized (this) { assert a : "b"; }
    new Outer<>() { int z; void k() {} };
    o.new Inner(1); C.this.x = C.super.y(); x >>>= 2; List<List<String>> n = null; i = (a) - b; s = @@@
      text "block"
      @@@;
    class L {} record P(int x) {} return;
  }
  enum K implements Z { A, B(1) { void f() {} }, ; int x; K() {} }
  @interface An { int v() default 3; String[] w(); }
  record R<T>(int a, T b) implements Q { R { } static int z; }
  interface I { default void m() {} }
}
""".replace("@@@", '"' * 3)
ZIG = r"""
// comment
const std = @import("std");
pub const Point = struct { x: i32 = 0, y: ?*const u8, pub fn len(self: Point) f64 { return @sqrt(self.x * self.x + 2 << 3); } };
const Kind = enum(u8) { a, b = 2, };
const E = error{ A, B };
extern fn puts(s: [*:0]const u8) c_int;
threadlocal var t: [4:0]u8 = undefined;
usingnamespace std;
test "x" { try std.testing.expect(a == b and !c); }
fn f(comptime T: type, xs: []const T, cb: fn (u8) void) E!void {
    var i: usize = 0;
    outer: while (i < 10) : (i += 1) { if (i == 3) continue :outer else break; }
    for (xs, 0..) |x, j| { _ = x; i += j; }
    const p = Point{ .x = 1, .y = null };
    const q = [_]u8{ 1, 2, 3 };
    const s = q[1..2];
    const r = switch (i) { 0, 1 => "a", 2...5 => |v| g(v), else => unreachable };
    defer std.debug.print("{s}\n", .{r});
    errdefer |e| { log(e); }
    const o = p.y orelse return error.A;
    const v = blk: { break :blk 5; };
    const w = h() catch |err| return err;
    const m =
        \\line one
        \\line two
    ;
    if (o.*.z) |k| { i = k; } else |e2| switch (e2) { else => {} }
    x.? = 'a';
    i = if (a) 1 else 2;
    while (it.next()) |n| i += n;
    return;
}
"""


@pytest.mark.parametrize(("source", "parse", "write"), [(JAVA, java.compilation_unit, java_text.text), (ZIG, zig.source_file, zig_text.text)])
def test_round_trip(source, parse, write):
    tree = run(parse, source)
    assert run(parse, write(tree)) == tree
    assert run(parse, write(run(parse, write(tree)))) == tree
    assert len(tables.flatten(tree)) > 500


def expression(text):
    return run(java.compilation_unit, f"class A {{ int x = {text}; }}")["types"][0]["members"][0]["variables"][0]["initializer"]


def shape(x):
    if x["type"] == "BinaryExpr":
        return f"({shape(x['left'])}{x['operator']}{shape(x['right'])})"
    return x.get("name", {}).get("identifier") if "name" in x else x.get("value")


@pytest.mark.parametrize(("text", "expected"), [("a + b * c - d", "((a+(b*c))-d)"), ("a || b && c == d", "(a||(b&&(c==d)))"), ("a >> b >>> c > d", "(((a>>b)>>>c)>d)"), ("a < b & c | d ^ e", "(((a<b)&c)|(d^e))")])
def test_java_binding(text, expected):
    assert shape(expression(text)) == expected


def test_java_casts_and_generics():
    assert expression("(A) b")["type"] == "CastExpr" and expression("(a) - b")["type"] == "BinaryExpr" and expression("(int) -b")["type"] == "CastExpr"
    assert expression("(a) -> b")["isEnclosingParameters"] and not expression("a -> b")["isEnclosingParameters"]
    assert expression("new A<B<C>>(1) { }")["type_"]["typeArguments"][0]["typeArguments"][0]["name"]["identifier"] == "C"
    assert [expression(x)["type"] for x in ("1", "1L", "1.5", "1e3", "0x1F", "'c'", "1f")] == [f"{k}LiteralExpr" for k in ("Integer", "Long", "Double", "Double", "Integer", "Char", "Double")]
    tree = run(java.compilation_unit, "import a.b.*; class A {}")
    assert tree["imports"][0]["isAsterisk"] and tree["imports"][0]["name"] == {"type": "Name", "identifier": "b", "qualifier": {"type": "Name", "identifier": "a"}}


def test_zig_binding():
    value = lambda text: run(zig.source_file, f"const a = {text};")["members"][0]["initExpr"]
    assert shape_zig(value("a + b * c << d")) == "((a+(b*c))<<d)" and shape_zig(value("a == b and c orelse d")) == "((a==b)and(corelsed))"
    assert value("?*const [4]u8")["child"]["child"]["type"] == "ArrayType" and value("E!T")["type"] == "ErrorUnionType"
    assert value(".{ .a = 1 }")["type"] == "StructInitExpr" and value(".{1}")["type"] == "ArrayInitExpr" and value("T{}")["operand"]["name"] == "T"
    assert value("0x1.8p3")["type"] == "FloatLiteral" and value("0xe0")["type"] == "IntegerLiteral" and value("a[1..]")["type"] == "SliceExpr"


def shape_zig(x):
    return f"({shape_zig(x['left'])}{x['operator']}{shape_zig(x['right'])})" if x["type"] == "BinaryExpr" else x["name"]


@pytest.mark.parametrize(("parse", "text"), [(java.compilation_unit, "class A {"), (java.compilation_unit, "class A { int x = ; }"), (java.compilation_unit, "class int {}"), (java.compilation_unit, "class A { int x = \"a }"), (java.compilation_unit, "class A { int x = " + "(" * 5000 + "; }"), (zig.source_file, "const a = ;"), (zig.source_file, "fn f() void {"), (zig.source_file, "const a = " + "(" * 5000), (zig.source_file, "const fn = 1;")])
def test_failures(parse, text):
    with pytest.raises(ParseFailure) as e:
        run(parse, text)
    assert 0 < e.value.position <= len(text)


@pytest.mark.parametrize("text", ["", "  // nothing\n"])
def test_empty(text):
    assert run(java.compilation_unit, text)["types"] == [] and run(zig.source_file, text)["members"] == []


def test_furthest_failure():
    with pytest.raises(ParseFailure) as e:
        run(java.compilation_unit, "class A { void f() { g(1, ); } }")
    assert e.value.position == len("class A { void f() { g(1, ")


def test_printed_columns(spark):
    df = spark.createDataFrame([(1, "class A {}"), (2, None), (3, "class")], "id long, s string")
    parsed = tables.parse_column(df, "s", "java")
    rows = {r.id: r for r in tables.print_column(parsed, "value", "java").collect()}
    assert rows[1].text == "class A {}\n" and rows[2].text is None and rows[3].text is None and rows[3].error.name == "Unexpected"
    assert json.loads(rows[1].value)["type"] == "CompilationUnit"


SMALI = r"""# comment
.class public final Lpkg/A;
.super Ljava/lang/Object;
.source "A.java"
.implements Ljava/lang/Runnable;

.annotation runtime Lpkg/N;
    value = {
        "a\nA",
        .enum Lpkg/E;->X:Lpkg/E;
    }
    sub = .subannotation Lpkg/S;
        n = 0x1t
    .end subannotation
.end annotation

.field private static final X:J = -0x2L
.field y:Ljava/lang/String;
    .annotation build Lpkg/N;
    .end annotation
.end field
.field static z:F = 1.5f

.method public constructor <init>(IJ)V
    .locals 2
    .param p1, "n"    # I
        .annotation runtime Lpkg/N;
        .end annotation
    .end param
    .prologue
    .line 10
    .local v0, "x":I
    .local v1, "s":Ljava/util/List;, "Ljava/util/List<I>;"
    :try_start_0
    const-string v0, "hi, # there"
    invoke-direct {p0}, Ljava/lang/Object;-><init>()V
    invoke-virtual/range {v0 .. v1}, Lpkg/A;->f([I)J
    :try_end_0
    .catch Ljava/lang/Exception; {:try_start_0 .. :try_end_0} :catch_0
    .catchall {:try_start_0 .. :try_end_0} :catch_0
    packed-switch p1, :pswitch_data_0
    :goto_0
    const/16 v1, -0x7
    iget-object v0, p0, Lpkg/A;->y:Ljava/lang/String;
    .end local v0
    .restart local v0
    goto :goto_0
    :catch_0
    :pswitch_0
    return-void
    :pswitch_data_0
    .packed-switch 0x1
        :goto_0
        :pswitch_0
    .end packed-switch
.end method

.method abstract m()V
.end method
"""


def test_smali():
    tree = run(smali.class_definition, SMALI)
    assert tree["class"] == "Lpkg/A;" and tree["interfaces"] == ["Ljava/lang/Runnable;"] and tree["source_file"] == "A.java"
    assert tree["annotations"][0]["elements"][0]["value"]["value"][0]["value"] == "a\nA" and tree["annotations"][0]["elements"][1]["value"]["value"]["elements"][0]["value"] == {"type": "byte", "value": 1}
    assert [(f["name"], f["kind"], f["value"] and f["value"]["value"], len(f["annotations"])) for f in tree["fields"]] == [("X", "static", -2, 0), ("y", "instance", None, 1), ("z", "static", 1.5, 0)]
    first, second = tree["methods"]
    code = first["code"]
    assert (code["registers"], code["ins"], code["outs"]) == (6, 4, 2) and first["prototype"]["shorty"] == "VIJ" and second["code"] is None
    assert code["instructions"][0]["string"] == "hi, # there" and code["instructions"][3]["target_index"] == 8
    assert code["instructions"][8] == {"operation": "packed-switch-payload", "first": 1, "target_indices": [4, 7], "owner_index": 3}
    assert code["tries"][0] == {"start_index": 0, "end_index": 3, "exception": "Ljava/lang/Exception;", "handler_index": 7}
    assert code["debug"][3]["type"] == "Ljava/util/List;" and first["parameters"][0]["register"] == 3


BODY = ".class LA;\n.super LB;\n.method static f(DI)V\n.locals 1\n{}\n.end method\n"


@pytest.mark.parametrize("body", ["goto :nowhere", "const/4 v9, 0x0", ":a\n:a\nreturn-void", "made-up v0", ".packed-switch 0x0\n.end packed-switch", "invoke-static {v1 .. v0}, LA;->f()V", "const-string v0, \"open", ".catch LE; {:a .. :b} :c\nnop", "goto"])
def test_smali_failures(body):
    source = BODY.format(body)
    if body == "goto":
        assert run(smali.class_definition, source)["methods"][0]["code"]["instructions"][0]["registers"] == []
        return
    with pytest.raises(ParseFailure):
        run(smali.class_definition, source)


def test_smali_payloads():
    got = run(smali.class_definition, BODY.format("sparse-switch p2, :s\nfill-array-data v0, :d\n:x\nreturn-void\n:s\n.sparse-switch\n-0x1 -> :x\n.end sparse-switch\n:d\n.array-data 1\n0x1t\n-0x2t\n.end array-data"))
    code = got["methods"][0]["code"]
    assert code["registers"] == 4 and code["instructions"][0]["registers"] == [3]
    assert code["instructions"][3] == {"operation": "sparse-switch-payload", "keys": [-1], "target_indices": [2], "owner_index": 0}
    assert code["instructions"][4] == {"operation": "fill-array-data-payload", "width": 1, "data": [1, -2], "owner_index": 1}


JAVASCRIPT = r'''"use strict";
// c
var a = 1, b = a / 2 / 3, r = /x[/]\/y/gi.test(s);
let { x, y: [z = 1, ...w], ...rest } = obj; const f = async (p, { q = 2 } = {}, ...more) => await p ** 2;
function* g(n) { yield n; yield* g(n - 1); for (let i = 0, k; i < n; i++, k--) continue; }
class A extends B.c { static #p = 1; m() { return super.m(`t ${a + `n ${b}`} {z}`); } get v() { return this.#p } static { } async *gen() {} constructor() { super(); } [k] = 3; }
outer: for (const k in o) { if (k) break outer; else { } }
for (const v of [1, , 2]) do { } while (v)
switch (q) { case 1: case 2: f(); break; default: }
try { throw new Error("e\n") } catch ({ m }) { } finally { }
o?.a?.[b]?.(c).d; x = y ? z : (1, 2); [p, q] = [q, p]; ({ a: n.b, c = 1 } = o);
const t = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, async f() {}, ...g };
a ?? b; a || b && c | d; typeof -x; delete o.p; i++; --j; new X; new Y.Z(1)(2); tag`a\n`
if (a) b
else c
result = 0x1F + 1_000 + .5 + 1e3 + 10n; (function () { return function named() { } })(); (() => ({}))()
while (1) ; ;
'''


def test_javascript_program():
    tree = run(javascript.program, JAVASCRIPT)
    assert run(javascript.program, javascript_text.text(tree)) == tree
    assert tree["body"][0]["directive"] == "use strict" and sum("directive" in x for x in tree["body"]) == 1
    kinds = {n[4] for n in tables.flatten(tree)}
    assert {"ChainExpression", "TemplateLiteral", "ArrowFunctionExpression", "ObjectPattern", "YieldExpression", "AwaitExpression", "PropertyDefinition", "StaticBlock", "TaggedTemplateExpression"} <= kinds


@pytest.mark.parametrize("text", ["(a, b)", "(a = b) + c", "(a + b) * c", "a - (b - c)", "(-a) ** b", "a ** b ** c", "(a ** b) ** c", "(() => 1)()", "(async () => {})()", "new (f())()", "new (a.b().c)()", "(new X).y", "(a ?? b) || c", "- -a", "+ ++a", "-(-1)", "(a, b) ? c : d", "(a ? b : c) ? d : e", "1..x", "(1).x", "(a?.b).c", "a?.b.c", "typeof (() => 1)", "(function(){})()", "({}).x", "() => ({})", "() => ({}).x", "!(a in b)", "(yield_)", "`a${`b${c}`}`", "a = b = c", "(x => x) || y", "class extends (a, b) {}", "[...a, , ]", "[,]", "({ ...a })", "a / b / c", "x ? /a/ : /b/g"])
def test_javascript_parentheses(text):
    tree = run(javascript.program, f"x = {text};")
    assert run(javascript.program, javascript_text.text(tree)) == tree


def value_of(text):
    return run(javascript.program, text)["body"][0]["expression"]


def test_javascript_values():
    assert [value_of(x)["value"] for x in ("0x1F", "1_000", ".5", "1e3", "0b11", "'a\\x41\\u{1F600}\\n'")] == [31, 1000, 0.5, 1000, 3, "aA\U0001f600\n"]
    assert value_of("10n")["bigint"] == "10" and value_of("/a[/]b/gi")["regex"] == {"pattern": "a[/]b", "flags": "gi"}
    assert value_of("a / b / c")["operator"] == "/" and value_of("a ** b ** c")["right"]["operator"] == "**" and value_of("a - b - c")["left"]["operator"] == "-"
    assert len(run(javascript.program, "a\nb\n++c")["body"]) == 3 and run(javascript.program, "function f() { return\n1 }")["body"][0]["body"]["body"][0]["argument"] is None


@pytest.mark.parametrize("text", ["a b", "(", "x = ;", "`a", "`${`", "let", "for (;;", "throw\n1", "({a b})", "class {}", "1 = 2", "x = " + "(" * 5000, "try {}"])
def test_javascript_failures(text):
    if text == "let":
        assert value_of(text)["name"] == "let"
        return
    with pytest.raises(ParseFailure):
        run(javascript.program, text)
