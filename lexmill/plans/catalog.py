"""Registered queries of the grammar and relational operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import sequence as S
from ..operators import columns as G
from ..operators import writers as W
from ..sources import android_package, dalvik_bytecode, dex_writer, keystore, s_expression, shell, shell_text, tables, zip_archive
from ..sources import bson as bson_format
from ..operators.cursor import run
from .dex_tables import Executables
from . import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(name: str, table: str, key: str, sql: str | None, **columns: Callable[[], Column]) -> None:
    """A query that keeps the key and adds columns."""
    QUERIES[name] = lambda spark, sf_dir: t(spark, sf_dir, table).select(key, *(make().alias(c) for c, make in columns.items()))
    if sql:
        SQL[name] = sql


C = F.col
value = lambda p, column: G.parse_prefix(p, C(column))["value"]
value2 = lambda p, x: G.parse_prefix(p, x)["value"]

# sequence primitives
over("sequence_length", "documents", "doc_id", "select doc_id, length(text)::int as chars, strlen(text)::int as bytes from documents", chars=lambda: S.length(C("text")), bytes=lambda: F.octet_length("text"))
over("sequence_at", "documents", "doc_id", "select doc_id, nullif(substring(text, 3, 1), '') as third, right(text, 1) as last from documents where true", third=lambda: S.at(C("text"), 2), last=lambda: S.at(C("text"), -1))
over("sequence_slice", "documents", "doc_id", "select doc_id, case when length(text) >= 12 then substring(text, 5, 8) end as piece from documents", piece=lambda: S.slice_(C("text"), 4, 12))
over("sequence_index_of", "documents", "doc_id", "select doc_id, case when instr(substring(text, 6), 'th') > 0 then instr(substring(text, 6), 'th') + 4 else -1 end::int as place from documents", place=lambda: S.index_of(C("text"), "th", 5))
over("sequence_concat", "pages", "page_id", "select page_id, concat(url, '#', page_id::varchar) as joined, url = concat(url, '') as same from pages", joined=lambda: S.concat(C("url"), F.lit("#"), C("page_id").cast("string")), same=lambda: S.equals(C("url"), S.concat(C("url"), F.lit(""))))
over("sequence_from", "part", "p_partkey", "select p_partkey, concat(p_brand, p_type) as text, chr((65 + p_size % 26)::int) as letter from part", text=lambda: S.string_from(F.array("p_brand", "p_type")), letter=lambda: F.decode(S.bytes_from(F.array(C("p_size") % 26 + 65)), "UTF-8"))
over("sha1_digest", "documents", "doc_id", "select doc_id, sha1(text) as digest from documents", digest=lambda: F.sha1(F.encode("text", "UTF-8")))

# elements and fixed sequences
over("element", "documents", "doc_id", "select doc_id, substring(text, 1, 1) as e, 1::int as used from documents where length(text) > 0", e=lambda: value(G.element(), "text"), used=lambda: G.parse_prefix(G.element(), C("text"))["position"])
over("predicate_element", "documents", "doc_id", "select doc_id, case when regexp_matches(substring(text, 1, 1), '[A-Z]') then substring(text, 1, 1) end as capital from documents", capital=lambda: value(G.predicate_element(lambda e: e.rlike("[A-Z]")), "text"))
over("fixed_length", "documents", "doc_id", "select doc_id, case when length(text) >= 16 then substring(text, 1, 16) end as head from documents", head=lambda: value(G.fixed(16), "text"))
over("skip", "documents", "doc_id", "select doc_id, substring(text, 11, 5) as after from documents where length(text) >= 15 union all select doc_id, null from documents where length(text) < 15", after=lambda: value(G.object_({"_pass": G.skip(10), "after": G.fixed(5)}), "text")["after"])
over("skip_to", "documents", "doc_id", "select doc_id, case when strlen(text) >= 24 then substr(hex(encode(text)), 41, 8) end as word from documents", word=lambda: F.hex(value2(G.bind(G.fixed(4), lambda _: G.bind(G.skip_to(4, 20), lambda _: G.fixed(4))), F.encode("text", "UTF-8"))))
over("end_of_input", "pages", "page_id", "select page_id, regexp_matches(url, '^[a-z]+://[^/]+/$') as only_host from pages", only_host=lambda: G.parse(G.tuple_([G.regex("[a-z]+://[^/]+/"), G.end_of_input()]), C("url")).isNotNull())
over("slice_bounded", "documents", "doc_id", "select doc_id, case when length(text) >= 20 and instr(substring(text, 1, 20), ' ') > 0 then (instr(substring(text, 1, 20), ' ') - 1)::int end as first_word from documents", first_word=lambda: F.length(value(G.slice_bounded(G.terminated(" "), 20, all_of_it=False), "text")))
over("consumed_sequence", "pages", "page_id", "select page_id, regexp_extract(url, '^[a-z]+', 0) as raw, length(regexp_extract(url, '^[a-z]+', 0))::int as used from pages", raw=lambda: value(G.consumed(G.regex("[a-z]+")), "url")["raw"], used=lambda: G.parse_prefix(G.regex("[a-z]+"), C("url"))["position"])


@query("exact_sequence_filter", "select page_id, url from pages where starts_with(url, 'https://')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").where(C("url").startswith("https://")).select("page_id", "url")


over("exact_sequence", "pages", "page_id", "select page_id, case when starts_with(url, 'http://') then 'http://' end as scheme from pages", scheme=lambda: value(G.exact("http://"), "url"))

# terminated and separated
over("element_terminated_sequence", "documents", "doc_id", "select doc_id, case when instr(text, '.') > 0 then split_part(text, '.', 1) end as sentence from documents", sentence=lambda: value(G.terminated("."), "text"))
over("sequence_terminated_sequence", "pages", "page_id", "select page_id, (instr(html, '</title>') - 1)::int as place, (instr(html, '</title>') + 7)::int as after from pages where instr(html, '</title>') > 0", place=lambda: F.length(value(G.terminated("</title>", take_end=False), "html")), after=lambda: G.parse_prefix(G.terminated("</title>"), C("html"))["position"])


@query("element_terminated_array", "select doc_id, len(string_split(text, '.'))::int - 1 as n, string_split(text, '.')[len(string_split(text, '.')) - 1] as last from documents where ends_with(text, '.')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = value(G.terminated_pieces("."), "text")
    return t(spark, sf_dir, "documents").where(C("text").endswith(".")).select("doc_id", F.size(pieces).alias("n"), F.element_at(pieces, -1).alias("last"))


@query("terminated_array", "select page_id, length(regexp_extract(url, '^([a-z]*):', 1))::int as n, ':' as ending from pages where regexp_matches(url, '^[a-z]*:')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = value(G.terminated_array("[a-z]", ":"), "url")
    return t(spark, sf_dir, "pages").select("page_id", F.size(v["items"]).alias("n"), v["end"].alias("ending")).where("ending is not null")


@query("separated_array_explode", "select doc_id, (i - 1)::int as pos, string_split(text, chr(10))[i] as line from (select doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.posexplode(value(G.pieces("\n"), "text")).alias("pos", "line"))


over("separated_array", "pages", "page_id", "select page_id, regexp_extract(url, '://([^/:?#]*)', 1) as host, len(string_split(regexp_extract(url, '^[a-z]+://([a-z0-9]+([.][a-z0-9]+)*)', 1), '.'))::int as labels from pages", host=lambda: F.regexp_extract("url", "://([^/:?#]*)", 1), labels=lambda: F.size(value(G.object_({"_scheme": G.regex("[a-z]+://"), "labels": G.separated("[a-z0-9]+", "[.]", 1)}), "url")["labels"]))
over("separated_non_empty", "documents", "doc_id", "select doc_id, case when regexp_matches(text, '^[A-Za-z]+') then len(string_split(regexp_extract(text, '^[A-Za-z]+( [A-Za-z]+)*', 0), ' '))::int end as words from documents", words=lambda: F.size(value(G.separated("[A-Za-z]+", " ", 1), "text")))

# structure
over("object", "pages", "page_id", "select page_id, regexp_extract(url, '^([a-z]+)://([^/]+)', 1) as scheme, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) as host, 'page' as kind from pages", **{k: (lambda k=k: value(G.object_({"scheme": G.regex("[a-z]+"), "_sep": G.exact("://"), "host": G.regex("[^/]+"), "kind": "page"}), "url")[k]) for k in ("scheme", "host", "kind")})
over("tuple", "documents", "doc_id", "select doc_id, substring(text, 1, 2) as a, substring(text, 3, 3) as b from documents where length(text) >= 5 union all select doc_id, null, null from documents where length(text) < 5", a=lambda: value(G.tuple_([G.fixed(2), G.fixed(3)]), "text")["_1"], b=lambda: value(G.tuple_([G.fixed(2), G.fixed(3)]), "text")["_2"])
over("map_result", "documents", "doc_id", "select doc_id, concat(substring(text, 1, 4), '!') as head from documents where length(text) >= 4 union all select doc_id, null from documents where length(text) < 4", head=lambda: value(G.mapped(G.fixed(4), lambda v: F.concat(v, F.lit('!'))), "text"))
over("bind_length_prefix", "events", "event_id", "select event_id, substring(event_type, 1, (event_id % 3)::int) as prefix from events", prefix=lambda: G.parse_prefix(G.bind(G.mapped(G.fixed(1), lambda v: v.cast("int")), lambda n: G.fixed(n)), F.concat((C("event_id") % 3).cast("string"), C("event_type")))["value"])
over("array_findall", "pages", "page_id", "select page_id, len(regexp_extract_all(html, '<p>', 0))::int as n from pages", n=lambda: F.size(value(G.many("(?s:.*?)<p>"), "html")))
over("array", "documents", "doc_id", "select doc_id, length(regexp_extract(text, '^[A-Za-z]*', 0))::int as letters from documents", letters=lambda: F.size(value(G.many("[A-Za-z]"), "text")))
over("non_empty_array", "documents", "doc_id", "select doc_id, nullif(length(regexp_extract(text, '^[a-z]*', 0)), 0)::int as letters from documents", letters=lambda: F.size(value(G.many("[a-z]", 1), "text")))
over("list", "pages", "page_id", "select page_id, list_aggregate(string_split(url, '/'), 'string_agg', '>') as path from pages", path=lambda: F.array_join(value(G.pieces("/"), "url"), ">"))
over("quantifier", "documents", "doc_id", "select doc_id, case when length(text) >= 16 then array_to_string(list_transform(range(0, 4), lambda i: substring(text, (i * 4 + 1)::int, 4)), '|') end as quads from documents", quads=lambda: F.array_join(value(G.quantifier(G.fixed(4), 4, 4), "text"), "|"))

# choice, option, looking ahead
over("disjunction", "pages", "page_id", "select page_id, case when starts_with(url, 'https') then 'https' when starts_with(url, 'http') then 'http' end as scheme from pages", scheme=lambda: value(G.first_of([G.exact("https"), G.exact("http")]), "url"))
over("union_exclusive", "pages", "page_id", "select page_id, case when starts_with(url, 'https://') then 'https://' when starts_with(url, 'http://') then 'http://' end as scheme from pages", scheme=lambda: value(G.exclusive([G.exact("https://"), G.exact("http://")]), "url"))
over("element_switch", "documents", "doc_id", "select doc_id, case substring(text, 1, 1) when 'T' then substring(text, 1, 3) when 'A' then substring(text, 1, 2) else substring(text, 1, 1) end as head from documents where length(text) >= 3 union all select doc_id, case substring(text, 1, 1) when 'T' then null when 'A' then case when length(text) >= 2 then substring(text, 1, 2) end else nullif(substring(text, 1, 1), '') end from documents where length(text) < 3", head=lambda: value(G.switch({"T": G.fixed(3), "A": G.fixed(2)}, G.fixed(1)), "text"))
over("optional", "pages", "page_id", "select page_id, nullif(regexp_extract(url, '^[a-z]+://(www[.])?', 1), '') as www from pages", www=lambda: value(G.object_({"_s": G.regex("[a-z]+://"), "www": G.optional(G.exact("www."))}), "url")["www"])
over("lookahead", "pages", "page_id", "select page_id, case when starts_with(url, 'http') then substring(url, 1, 5) end as head from pages", head=lambda: value(G.object_({"_see": G.lookahead(G.exact("http")), "head": G.fixed(5)}), "url")["head"])


# any rule, as often as it succeeds
SEGMENTS = G.object_({"_host": G.regex("[a-z]+://[^/]+"), "items": G.array_of(G.object_({"_slash": G.exact("/"), "name": G.regex("[^/]*")}))})
over("array_of_objects", "pages", "page_id", "select page_id, (len(string_split(regexp_replace(url, '^[a-z]+://[^/]+', ''), '/')) - 1)::int as n, substring(regexp_replace(url, '^[a-z]+://[^/]+', ''), 2) as path from pages", n=lambda: F.size(value(SEGMENTS, "url")["items"]), path=lambda: F.array_join(F.transform(value(SEGMENTS, "url")["items"], lambda x: x["name"]), "/"))
LABELS = G.object_({"_scheme": G.regex("[a-z]+://"), "labels": G.separated_by(G.object_({"first": G.element(), "more": G.regex("[a-z0-9]*")}), G.exact("."), 1)})
over("separated_by_rule", "pages", "page_id", "select page_id, regexp_extract(url, '^[a-z]+://([a-z0-9.]+)', 1) as host, len(string_split(regexp_extract(url, '^[a-z]+://([a-z0-9.]+)', 1), '.'))::int as labels from pages", host=lambda: F.array_join(F.transform(value(LABELS, "url")["labels"], lambda x: F.concat(x["first"], x["more"])), "."), labels=lambda: F.size(value(LABELS, "url")["labels"]))
UNTIL = G.array_until(G.object_({"letter": G.regex("[a-z]")}), G.exact("://"))
over("array_until_rule", "pages", "page_id", "select page_id, length(regexp_extract(url, '^([a-z]*)://', 1))::int as n, '://' as ending from pages", n=lambda: F.size(value(UNTIL, "url")["items"]), ending=lambda: value(UNTIL, "url")["end"])


@query("negative_lookahead", "select page_id, url from pages where not regexp_matches(url, '^https')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").where(G.negative_lookahead(G.exact("https"))(C("url")).isNotNull()).select("page_id", "url")


over("regexp_groups", "pages", "page_id", r"select page_id, regexp_extract(url, '^([a-z]+)://([^/]+)(/.*)?$', 2) as host, regexp_extract(url, '^([a-z]+)://([^/]+)(/.*)?$', 3) as path from pages", host=lambda: F.coalesce(value(G.regex_groups(r"([a-z]+)://([^/]+)(/.*)?$", 3), "url")[2], F.lit("")), path=lambda: F.coalesce(value(G.regex_groups(r"([a-z]+)://([^/]+)(/.*)?$", 3), "url")[3], F.lit("")))

# numbers
over("u32le", "documents", "doc_id", "select doc_id, case when strlen(text) >= 4 then ('0x' || substr(hex(encode(text)), 7, 2) || substr(hex(encode(text)), 5, 2) || substr(hex(encode(text)), 3, 2) || substr(hex(encode(text)), 1, 2))::bigint end as v from documents", v=lambda: N.uint(F.encode("text", "UTF-8"), 0, 4))
over("integers_round_trip", "orders", "o_orderkey", "select o_orderkey, o_orderkey as le, o_orderkey as be, (o_orderkey % 256)::bigint as low, (case when o_orderkey % 256 >= 128 then o_orderkey % 256 - 256 else o_orderkey % 256 end)::bigint as low_signed from orders",
     le=lambda: N.uint(N.to_bytes(C("o_orderkey"), 8), 0, 8).cast("long"), be=lambda: N.uint(N.to_bytes(C("o_orderkey"), 4, little=False), 0, 4, little=False), low=lambda: N.uint(N.to_bytes(C("o_orderkey"), 4), 0, 1), low_signed=lambda: N.sint(N.to_bytes(C("o_orderkey"), 4), 0, 1))
over("leb128", "orders", "o_orderkey", "select o_orderkey, (o_orderkey % 128 + 128 * 5)::bigint as u, 2::int as used, (o_orderkey % 128 + 128 * 5 - 1)::bigint as p1 from orders",
     u=lambda: N.uleb128(F.concat(N.to_bytes(C("o_orderkey") % 128 + 128, 1), F.lit(b"\x05")))["value"].cast("long"), used=lambda: N.uleb128(F.concat(N.to_bytes(C("o_orderkey") % 128 + 128, 1), F.lit(b"\x05")))["length"], p1=lambda: N.uleb128p1(F.concat(N.to_bytes(C("o_orderkey") % 128 + 128, 1), F.lit(b"\x05")))["value"].cast("long"))
over("nibbles", "lineitem", "l_orderkey", "select l_orderkey, (l_partkey % 256 // 16)::int as high, (l_partkey % 16)::int as low, ((4 - l_partkey % 4) % 4)::bigint as pad from lineitem", high=lambda: N.nibbles((C("l_partkey") % 256).cast("int"))["high"], low=lambda: N.nibbles((C("l_partkey") % 256).cast("int"))["low"], pad=lambda: N.align(C("l_partkey"), 4).cast("long"))
over("flags", "part", "p_partkey", "select p_partkey, p_size & 1 <> 0 as odd, p_size & 8 <> 0 as eight from part", odd=lambda: N.flags(C("p_size"), {"odd": 1, "eight": 8})["odd"], eight=lambda: N.flags(C("p_size"), {"odd": 1, "eight": 8})["eight"])
over("dos_datetime", "orders", "o_orderkey", "select o_orderkey, date_trunc('day', o_orderdate)::timestamp as day from orders", day=lambda: S.let(N.dos_words(F.date_trunc("day", C("o_orderdate"))), lambda w: N.dos_datetime(w["time"], w["date"])).cast("timestamp_ntz"))

# JSON
over("json_number", "events", "event_id", "select event_id, json_extract(props, '$.k')::bigint as k from events", k=lambda: G.parse(G.mapped(G.object_({"_open": G.exact('{"k": '), "k": G.regex("-?[0-9]+"), "_close": G.exact("}")}), lambda v: v["k"].cast("bigint")), C("props")))

# unparsing
over("array_unparse", "documents", "doc_id", "select doc_id, true as same from documents where text is not null", same=lambda: W.array_of(W.as_is(), "\n")(value(G.pieces("\n"), "text")) == C("text"))
over("record_unparse", "customer", "c_custkey", "select c_custkey, '<' || c_name || '|' || c_mktsegment || '>' as line from customer", line=lambda: W.fields({"_open": W.constant("<"), "c_name": W.as_is(), "_bar": W.constant("|"), "c_mktsegment": W.as_is(), "_close": W.constant(">")})(F.struct("c_name", "c_mktsegment")))
over("length_prefix_round_trip", "documents", "doc_id", "select doc_id, strlen(text)::bigint as n, true as same from documents where text is not null", n=lambda: N.uint(W.prefixed(W.as_is(), 4)(F.encode("text", "UTF-8")), 0, 4), same=lambda: G.parse(G.prefixed(4), W.prefixed(W.as_is(), 4)(F.encode("text", "UTF-8"))) == F.encode("text", "UTF-8"))
over("offset_table_unparse", "part", "p_partkey", "select p_partkey, 12::bigint as a, (12 + strlen(p_name))::bigint as b, (12 + strlen(p_name) + strlen(p_brand))::bigint as c, p_brand as brand from part",
     **{k: (lambda i=i: N.uint(W.with_table([F.encode(x, "UTF-8") for x in ("p_name", "p_brand", "p_type")]), 4 * i, 4)) for i, k in enumerate("abc")},
     brand=lambda: S.let(W.with_table([F.encode(x, "UTF-8") for x in ("p_name", "p_brand", "p_type")]), lambda b: F.decode(S.slice_(b, N.uint(b, 4, 4).cast("int"), N.uint(b, 8, 4).cast("int")), "UTF-8")))
over("adler32", "pages", "page_id", "select page_id, (((length(url) + list_sum(list_transform(range(1, length(url) + 1), lambda i: ascii(substring(url, i::int, 1)) * (length(url) - i + 1)))) % 65521) * 65536 + (1 + list_sum(list_transform(range(1, length(url) + 1), lambda i: ascii(substring(url, i::int, 1))))) % 65521)::bigint as checksum from pages", checksum=lambda: N.adler32(F.encode("url", "UTF-8")))
over("double_from_bytes", "part", "p_partkey", "select p_partkey, p_size::double / 8 as high_first, -p_size::double as low_first from part",
     **{k: (lambda of=of, little=little: N.double(F.concat(F.element_at(F.array(*(F.lit(struct.pack("<d" if little else ">d", of(i))) for i in range(1, 60))), C("p_size").cast("int")), F.encode("p_name", "UTF-8")), 0, little)) for k, of, little in (("high_first", lambda i: i / 8, False), ("low_first", lambda i: -float(i), True))})
over("type_test", "pages", "page_id", "select page_id, true as text_is_text, false as bytes_are_text from pages", text_is_text=lambda: S.is_text(C("url")), bytes_are_text=lambda: S.is_text(F.encode("url", "UTF-8")))


@query("output_offsets", "select conv_id, turn, (coalesce(sum(strlen(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint as \"offset\" from conversations")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.running_offset(t(spark, sf_dir, "conversations"), F.octet_length("text"), ["conv_id"], ["turn"]).select("conv_id", "turn", "offset")


@query("address_join", """with p as (select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::int as i, coalesce(sum(strlen(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as at, strlen(text) as n from conversations)
select a.conv_id, a.turn, b.i as target_index from p a left join p b on a.conv_id = b.conv_id and a.at + a.n = b.at""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    places = R.running_offset(t(spark, sf_dir, "conversations"), F.octet_length("text"), ["conv_id"], ["turn"], "at").select("conv_id", "turn", "at", F.octet_length("text").alias("n"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("i"))
    sources = places.select("conv_id", "turn", (C("at") + C("n")).alias("target"))
    return R.address_join(sources, "target", places, "at", "i", ["conv_id"]).select("conv_id", "turn", "target_index")


@query("id_resolution_join", "select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (t(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    out = R.resolve(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customer, "o_custkey", "c_custkey", "c_name", "c_name")
    out = R.resolve(out, customer, "o_custkey", "c_custkey", "c_nationkey", "c_nationkey")
    out = R.resolve(R.resolve(out, nation, "c_nationkey", "n_nationkey", "n_name", "n_name"), nation, "c_nationkey", "n_nationkey", "n_regionkey", "n_regionkey")
    return R.resolve(out, region, "n_regionkey", "r_regionkey", "r_name", "r_name").select("o_orderkey", "c_name", "n_name", "r_name")


@query("optional_resolution", "select s_suppkey, n_name from supplier left join (select * from nation where n_regionkey = 1) on s_nationkey = n_nationkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = t(spark, sf_dir, "nation").where("n_regionkey = 1")
    return R.resolve(t(spark, sf_dir, "supplier"), pool, "s_nationkey", "n_nationkey", "n_name", "n_name", optional=True).select("s_suppkey", "n_name")


@query("delta_decode", "select l_orderkey, l_linenumber, l_partkey - coalesce(lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey), 0) as delta, l_partkey as value from lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    coded = R.delta_encode(t(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey"], order)
    return R.delta_decode(coded, "delta", ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "delta", "value")


@query("positional_zip", """with u as (select conv_id, text as q, (row_number() over (partition by conv_id order by turn) - 1)::int as position from conversations where role = 'user'),
a as (select conv_id, text as a, (row_number() over (partition by conv_id order by turn) - 1)::int as position from conversations where role = 'assistant') select conv_id, position, q, a from u join a using (conv_id, position)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda role, name: t(spark, sf_dir, "conversations").where(C("role") == role).select("conv_id", "turn", C("text").alias(name))
    return R.zip_by_position(side("user", "q").withColumnRenamed("turn", "t1"), side("assistant", "a").withColumnRenamed("turn", "t2"), ["conv_id"], ["t1"], ["t2"]).select("conv_id", "position", "q", "a")


@query("dictionary_encode", "select event_type, min(event_id) as first, (row_number() over (order by min(event_id), event_type) - 1)::int as code from events group by event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dictionary(t(spark, sf_dir, "events"), "event_type", "event_id")


@query("any_and_all", "select user_id, bool_or(value > 50) as any_large, bool_and(value > 50) as all_large from events group by user_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.any_and_all(t(spark, sf_dir, "events"), ["user_id"], {"large": C("value") > 50})


@query("first_match", "select user_id, min(event_id) as event_id from events where value > 50 group by user_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_match(t(spark, sf_dir, "events"), ["user_id"], C("value") > 50, "event_id", "event_id")


@query("upsert", "select c_custkey, coalesce(o.total, c_acctbal) as balance from customer left join (select o_custkey, arg_max(o_totalprice, o_orderkey) as total from orders group by o_custkey) o on o_custkey = c_custkey union all select o_custkey, arg_max(o_totalprice, o_orderkey) from orders where o_custkey not in (select c_custkey from customer) group by o_custkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = t(spark, sf_dir, "customer").select("c_custkey", C("c_acctbal").alias("balance"))
    changes = t(spark, sf_dir, "orders").select(C("o_custkey").alias("c_custkey"), C("o_totalprice").alias("balance"), "o_orderkey")
    return R.upsert(base, changes, "c_custkey", "o_orderkey")


@query("section_tracking", 'select event_type as section, min(event_id) as "offset", count(*) as size from events group by event_type')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.track_sections(t(spark, sf_dir, "events").withColumnRenamed("event_type", "section"), "section", "event_id")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two alternatives get in each url, and how deep."""
    reach = lambda p: F.length(F.regexp_extract("url", p, 0))
    arms = F.array(F.struct(F.lit("host").alias("arm"), reach("^[a-z]+://[a-z.]*").alias("position"), F.lit(2).alias("depth")), F.struct(F.lit("secure").alias("arm"), reach("^https?:?").alias("position"), F.lit(1).alias("depth")))
    return t(spark, sf_dir, "pages").select("page_id", F.inline(arms))


_ARMS = "select page_id, 'host' as arm, length(regexp_extract(url, '^[a-z]+://[a-z.]*', 0))::int as position, 2::int as depth from pages union all select page_id, 'secure', length(regexp_extract(url, '^https?:?', 0))::int, 1::int from pages"


@query("furthest_error", f"select page_id, arm, position, depth from (select *, rank() over (partition by page_id order by position desc) as r from ({_ARMS})) where r = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_failures(_failures(spark, sf_dir), ["page_id"], "position")


@query("deepest_error", f"select page_id, arm, position, depth from (select *, rank() over (partition by page_id order by depth desc) as r from ({_ARMS})) where r = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_failures(_failures(spark, sf_dir), ["page_id"], "depth")


@query("chunk_invariance", "select doc_id, text as whole from documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.cut_chunks(t(spark, sf_dir, "documents").select("doc_id", "text"), "text", 100)
    return R.join_chunks(chunks, ["doc_id"], "seq", "chunk")


_RANGES = "select p_brand as brand, p_size as low, (p_size + 2)::int as high from part"


@query("charset_union", f"""with r as (select distinct * from ({_RANGES})), m as (select *, case when low <= max(high) over (partition by brand order by low, high rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as n from r),
i as (select *, sum(n) over (partition by brand order by low, high rows between unbounded preceding and current row) as island from m) select brand, min(low) as low, max(high) as high from i group by brand, island""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_ranges(t(spark, sf_dir, "part").select(C("p_brand").alias("brand"), C("p_size").alias("low"), (C("p_size") + 2).alias("high")).distinct(), ["brand"], "low", "high")


@query("charset_difference", """with a as (select distinct p_brand as brand, unnest(generate_series(p_size, p_size + 9)) as x from part where p_size <= 30), b as (select distinct p_brand as brand, unnest(generate_series(p_size, p_size)) as x from part where p_size > 30),
d as (select * from a except select * from b), g as (select *, x - row_number() over (partition by brand order by x) as island from d) select brand, min(x)::int as low, max(x)::int as high from g group by brand, island""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").select(C("p_brand").alias("brand"), C("p_size").alias("low")).distinct()
    wide, single = part.where("low <= 30").withColumn("high", C("low") + 9), part.where("low > 30").withColumn("high", C("low"))
    return R.subtract_ranges(wide, single, ["brand"], "low", "high")


# formats: what the writers write, the rules must read
@query("json_values", "select event_id, (json_extract(props, '$.k')::double) as k from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = tables.parse_column(t(spark, sf_dir, "events").select("event_id", "props"), "props", "json")
    return parsed.select("event_id", F.variant_get(F.parse_json("value"), "$.k", "double").alias("k"))


def _written(df: DataFrame, key: str, text: str, write: Callable[[int, str], bytes], out: str = "binary") -> DataFrame:
    """(key, data): texts written to another format."""
    import pyarrow as pa

    def rows(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([write(k, x) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])], names=[key, "data"])

    return df.select(key, text).mapInArrow(rows, f"{key} bigint, data {out}")


@query("json_failures", "select event_id, 'Unexpected' as name, (length(props) - 1)::bigint as position from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_off = t(spark, sf_dir, "events").select("event_id", F.expr("substring(props, 1, length(props) - 1)").alias("props"))
    return tables.parse_column(cut_off, "props", "json").select("event_id", "error.name", "error.position")


@query("symbolic_escapes", "select item_id, replace(text, ' ', chr(10)) as value from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _written(t(spark, sf_dir, "benchmark"), "item_id", "text", lambda k, x: s_expression.write({"type": "string", "value": x.replace(" ", "\n")}), "string")
    return tables.parse_column(data, "data", "s_expression").select("item_id", F.variant_get(F.parse_json("value"), "$.value", "string").alias("value"))


@query("zip_failures", "select item_id, true as failed, null::int as entry from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import UTC, datetime

    write = lambda k, x: zip_archive.write({"comment": "", "entries": [{"type": "file", "path": "f", "date": datetime(2001, 2, 3, tzinfo=UTC), "host": "unix", "compression": "store", "content": x.encode()}]}, False)[: -(k % 20 + 1)]
    return tables.zip_entries(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", write), "item_id", "data").select("item_id", C("error").isNotNull().alias("failed"), "entry")


@query("bson_round_trip", "select item_id, item_id::double as id, text from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _written(t(spark, sf_dir, "benchmark"), "item_id", "text", lambda k, x: bson_format.write({"id": k, "text": x, "tags": [True, None, 1.5]}))
    v = F.parse_json("value")
    return tables.parse_column(data, "data", "bson").select("item_id", F.variant_get(v, "$.id", "double").alias("id"), F.variant_get(v, "$.text", "string").alias("text"))


@query("zip_round_trip", "select item_id, 1::int as entry, 'texts/' || item_id || '.txt' as path, strlen(text)::int as n, text from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import UTC, datetime

    day = datetime(2001, 2, 3, 4, 5, 6, tzinfo=UTC)
    write = lambda k, x: zip_archive.write({"comment": "", "entries": [{"type": "directory", "path": "texts/", "date": day, "host": "unix"}, {"type": "file", "path": f"texts/{k}.txt", "date": day, "host": "unix", "compression": "deflate" if k % 2 else "store", "content": x.encode()}]}, bool(k % 3))
    entries = tables.zip_entries(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", write), "item_id", "data")
    return entries.where("type = 'file'").select("item_id", "entry", "path", F.octet_length("content").alias("n"), F.decode("content", "UTF-8").alias("text"))


@query("s_expression_nodes", "select item_id, len(string_split_regex(trim(text), '\\s+'))::bigint as atoms from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _written(t(spark, sf_dir, "benchmark"), "item_id", "text", lambda k, x: "(" + " ".join('"' + w + '"' for w in x.split()) + ")", "string")
    nodes = tables.node_table(data, "item_id", "data", "s_expression")
    return nodes.where("type = 'string'").groupBy("item_id").agg(F.count("*").alias("atoms"))


@query("regex_nodes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _written(t(spark, sf_dir, "benchmark"), "item_id", "text", lambda k, x: "(?:" + "|".join(x.split()).replace(".", "[.]") + r")+\d{2,3}[a-z]*$", "string")
    return tables.node_table(data, "item_id", "data", "regex").select("item_id", "node_id", "parent_id", "type", "field", "value")


@query("shell_nodes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _written(t(spark, sf_dir, "benchmark"), "item_id", "text", lambda k, x: f"A={k} echo '" + x.replace("\n", " ") + "' | sort -u > \"$HOME/out\" && (cd /; ls)", "string")
    return tables.node_table(data, "item_id", "data", "shell").select("item_id", "node_id", "parent_id", "type", "field", "value")


def _executables(spark: SparkSession, sf_dir: str) -> Executables:
    """A small executable for each benchmark item: class Lpkg/Item<id>; with one field and one method."""

    def write(k: int, x: str) -> bytes:
        body = [{"operation": "const-string", "a": 0, "index": 7}, {"operation": "iget", "a": 1, "b": 2, "index": 0}, {"operation": "invoke-virtual", "index": 0, "registers": [2, 1, 0]}, {"operation": "return-void"}]
        code = {"registers": 4, "ins": 3, "outs": 3, "instructions": body, "tries": [{"start": 0, "count": 4, "handlers": [{"type_idx": 2, "address": 7}], "catch_all": None}], "debug": {"line_start": k, "parameter_names": [None, 5], "codes": [{"op": "special", "value": 14}]}}
        strings = ["I", "LI", f"Lpkg/Item{k};", "Ljava/lang/Object;", "V", "count", "run", x]
        data = {"static_fields": [], "instance_fields": [{"idx": 0, "access_flags": 2}], "direct_methods": [], "virtual_methods": [{"idx": 0, "access_flags": 1, "code": code}]}
        notes = {"class": [{"visibility": "runtime", "type_idx": 1, "elements": [{"name_idx": 5, "value": {"type": "int", "value": k}}]}], "fields": [], "methods": [], "parameters": [{"idx": 0, "annotations": [[], [{"visibility": "build", "type_idx": 2, "elements": []}]]}]}
        return dex_writer.write(strings, [0, 2, 3, 4], [(1, 3, [0, 1])], [(1, 0, 5)], [(1, 0, 6)], [{"class_idx": 1, "access_flags": 1, "superclass_idx": 2, "source_file_idx": 7 if k % 2 else 0xFFFFFFFF, "interfaces": [], "data": data, "annotations": notes}])

    return Executables(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", write), "item_id", "data")


@query("dex_classes", "select item_id, 'Lpkg/Item' || item_id || ';' as class, 'Ljava/lang/Object;' as superclass, case when item_id % 2 = 1 then text end as source_file from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executables(spark, sf_dir).classes().select("item_id", "class", "superclass", "source_file")


@query("dex_methods", "select item_id, 'Lpkg/Item' || item_id || ';' as class, 'run' as name, 'V' as returns, 'I,Lpkg/Item' || item_id || ';' as parameters from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executables(spark, sf_dir).methods().select("item_id", "class", "name", "returns", F.array_join("parameters", ",").alias("parameters"))


@query("dex_members", "select item_id, unnest(['instance_fields', 'virtual_methods']) as kind, unnest(['count', 'run']) as name, unnest([2::bigint, 1::bigint]) as access_flags from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executables(spark, sf_dir).members().select("item_id", "kind", "name", "access_flags")


@query("dex_operands", "select item_id, unnest([0, 1, 2, 3]) as place, unnest(['const-string', 'iget', 'invoke-virtual', 'return-void']) as operation, unnest([text, 'Lpkg/Item' || item_id || ';->count:I', 'Lpkg/Item' || item_id || ';->run(ILpkg/Item' || item_id || ';)V', null]) as operand from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executables(spark, sf_dir).instructions().select("item_id", "place", "operation", "operand")


@query("dex_tries", "select item_id, 0::bigint as method_idx, item_id as line_start, 0::bigint as start, 4::bigint as n, 7::bigint as address from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _executables(spark, sf_dir).bodies().select("item_id", "method_idx", C("debug.line_start").alias("line_start"), F.inline("tries"))
    return each.select("item_id", "method_idx", "line_start", "start", C("count").alias("n"), F.explode("handlers.address").alias("address"))


@query("dex_annotations", "select item_id, unnest(['class', 'parameter']) as target, unnest(['runtime', 'build']) as visibility, unnest(['Lpkg/Item' || item_id || ';', 'Ljava/lang/Object;']) as type, unnest([item_id::varchar, null]) as value from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executables(spark, sf_dir).annotations().select("item_id", "target", "visibility", "type", F.try_element_at(C("elements.value.value"), F.lit(1)).alias("value"))


@query("dalvik_instructions", "select item_id, unnest([0, 1, 2]) as place, unnest(['const/16', 'add-int/lit8', 'return']) as operation, unnest([0, 2, 4]) as units from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda k, x: dalvik_bytecode.write([{"operation": "const/16", "a": 0, "literal": k % 1000}, {"operation": "add-int/lit8", "a": 0, "b": 0, "literal": 1}, {"operation": "return", "a": 0}])
    parsed = tables.parse_column(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", code), "data", "dalvik")
    return parsed.select("item_id", F.posexplode(F.from_json("value", "array<struct<operation string, offset int>>")).alias("place", "x")).select("item_id", "place", "x.operation", F.col("x.offset").alias("units"))


@query("keystore_entries", "select item_id, 'key' || item_id as alias, item_id * 1000 as created from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    write = lambda k, x: keystore.write({"implementation": "JCEKS" if k % 2 else "JKS", "version": 2, "entries": [{"alias": f"key{k}", "created_millis": k * 1000, "private_key": x.encode(), "certificates": []}], "hash": bytes(20)})
    parsed = tables.parse_column(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", write), "data", "keystore")
    return parsed.select("item_id", F.inline(F.from_json("value", "entries array<struct<alias string, created_millis bigint>>")["entries"])).withColumnRenamed("created_millis", "created")


@query("apk_signing_pairs", "select item_id, unnest([7::bigint, 1114793335]) as id from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    import struct
    from datetime import UTC, datetime

    def write(k: int, x: str) -> bytes:
        data = zip_archive.write({"entries": [{"type": "file", "path": "a", "date": datetime(2000, 1, 1, tzinfo=UTC), "content": x.encode(), "compression": "store"}]})
        at, end = data.index(zip_archive.CENTRAL), data.rindex(zip_archive.END)
        block = android_package.write_block([(7, b"v"), (android_package.PADDING, bytes(k % 9))])
        return data[:at] + block + data[at : end + 16] + struct.pack("<I", at + len(block)) + data[end + 20 :]

    parsed = tables.parse_column(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", write), "data", "apk")
    return parsed.select("item_id", F.inline(F.from_json("value", "signing_block struct<pairs array<struct<id bigint>>>")["signing_block"]["pairs"]))


@query("shell_round_trip", "select item_id, true as same from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    def same(k: int, x: str) -> str:
        tree = run(shell.script, f"A={k} echo '" + x + "' \"$HOME\" > out && (cd /; ls) | wc -l")
        return str(run(shell.script, shell_text.script(tree)) == tree).lower()

    return _written(t(spark, sf_dir, "benchmark"), "item_id", "text", same, "string").select("item_id", C("data").cast("boolean").alias("same"))

def _java(k: int, x: str) -> str:
    """A class for each item: a field for each of the text's words, a method that returns how many there are."""
    fields = "".join(f"  private static final String W{i} = \"{w}\";\n" for i, w in enumerate(x.replace('"', "").replace("\\", "").split()))
    return f"package p;\nimport java.util.*;\n/** {k} */\npublic class Item{k} extends Object {{\n{fields}  int count(List<Map<String, int[]>> m) {{ for (int i = 0; i < {k}; i++) if (m == null) return i >> 1; return {k}; }}\n}}\n"


def _zig(k: int, x: str) -> str:
    return f"const std = @import(\"std\");\npub const Item{k} = struct {{ id: u64 = {k}, next: ?*Item{k} = null, }};\npub fn count(xs: []const u8) !usize {{ var n: usize = 0; for (xs, 0..) |c, i| {{ if (c == 'a' and i > {k}) n += 1; }} return n; }}\n"


@query("java_fields", """with w as (select item_id, string_split_regex(trim(replace(replace(text, '"', ''), '\\', ''), E' \\n\\r\\t'), '\\s+') as w from benchmark), e as (select item_id, unnest(w) as value, generate_subscripts(w, 1) as i from w)
select item_id, ('W' || (i - 1)) as name, value from e""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.node_table(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", _java, "string"), "item_id", "data", "java").where("type in ('VariableDeclarator', 'SimpleName', 'StringLiteralExpr') or field in ('identifier', 'value')")
    up = lambda kind, field: nodes.where(C("type") == kind).select("item_id", C("node_id").alias("me"), C("parent_id").alias("up")).join(nodes.where(C("field") == field).select("item_id", C("parent_id").alias("me"), "value"), ["item_id", "me"]).drop("me")
    declared = nodes.where("type = 'VariableDeclarator'").select("item_id", C("node_id").alias("up"))
    names, values = up("SimpleName", "identifier").withColumnRenamed("value", "name"), up("StringLiteralExpr", "value")
    return declared.join(names, ["item_id", "up"]).join(values, ["item_id", "up"]).select("item_id", "name", "value")


def _printed(spark: SparkSession, sf_dir: str, form: str, write: Callable[[int, str], str]) -> DataFrame:
    """Whether printing and parsing again gives the same tree."""
    once = tables.parse_column(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", write, "string"), "data", form).select("item_id", C("value").alias("tree"))
    again = tables.parse_column(tables.print_column(once, "tree", form), "text", form)
    return again.select("item_id", (C("tree") == C("value")).alias("same"))


@query("java_round_trip", "select item_id, true as same from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, sf_dir, "java", _java)


@query("zig_round_trip", "select item_id, true as same from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, sf_dir, "zig", _zig)


@query("zig_declarations", "select item_id, unnest(['std', 'Item' || item_id, 'count', 'n']) as name, unnest(['VarDecl', 'VarDecl', 'FnDecl', 'VarDecl']) as type from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.node_table(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", _zig, "string"), "item_id", "data", "zig")
    declared = nodes.where("type in ('VarDecl', 'FnDecl')").select("item_id", C("node_id").alias("parent_id"), "type")
    return declared.join(nodes.where("field = 'name'").select("item_id", "parent_id", C("value").alias("name")), ["item_id", "parent_id"]).select("item_id", "name", "type")



def _javascript(k: int, x: str) -> str:
    return f"'use strict';\nclass Item{k} {{ static id = {k}; get half() {{ return this.n / 2 }} }}\nconst words = [{', '.join(repr(w) for w in x.split())}]\nfor (const w of words) if (/^a/.test(w)) console.log(`${{w}} ${{w.length > {k} ? 'long' : 'short'}}`)\n"


@query("javascript_round_trip", "select item_id, true as same from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, sf_dir, "javascript", _javascript)


@query("javascript_numbers", "select item_id, unnest(['2', item_id::varchar]) as value, unnest(['BinaryExpression', 'PropertyDefinition']) as inside from benchmark union all select item_id, item_id::varchar, 'BinaryExpression' from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.node_table(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", _javascript, "string"), "item_id", "data", "javascript")
    numbers = nodes.where("field = 'value' and type = 'int'").select("item_id", C("parent_id").alias("node_id"), C("value").alias("number"))
    literals = nodes.where("type = 'Literal'").join(numbers, ["item_id", "node_id"]).select("item_id", C("parent_id").alias("node_id"), C("number").alias("value"))
    return literals.join(nodes.select("item_id", "node_id", C("type").alias("inside")), ["item_id", "node_id"]).select("item_id", "value", "inside")


SMALI = "struct<class string, superclass string, source_file string, fields array<struct<name string, field_type string, value struct<type string, value string>>>, methods array<struct<name string, prototype struct<shorty string>, kind string, access_flags array<string>, code struct<registers int, ins int, instructions array<struct<operation string, registers array<int>, literal long, string string, target_index int>>, tries array<struct<start_index int, end_index int, handler_index int>>>>>>"


def _smali(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each item with a field that holds the item's id and a method that counts down from it."""

    def write(k: int, x: str) -> str:
        literal = x.replace("\\", "").replace('"', "").replace("\n", " ")
        body = f'    .locals 1\n    const/16 v0, {k % 1000:#x}\n    :top\n    const-string p1, "{literal}"\n    if-lez v0, :out\n    add-int/lit8 v0, v0, -0x1\n    goto :top\n    :out\n    return-void\n    .catchall {{:top .. :out}} :out\n'
        return f'.class public Lpkg/Item{k};\n.super Ljava/lang/Object;\n.source "{k}.java"\n\n.field static final ID:J = {k:#x}L\n\n.method private run(JLjava/lang/String;)V\n{body}.end method\n'

    parsed = tables.parse_column(_written(t(spark, sf_dir, "benchmark"), "item_id", "text", write, "string"), "data", "smali", strict=True)
    return parsed.select("item_id", F.from_json("value", SMALI).alias("x")).select("item_id", "x.*")


@query("smali_fields", "select item_id, 'Lpkg/Item' || item_id || ';' as class, item_id || '.java' as source_file, 'ID' as name, 'J' as type, item_id as value from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smali(spark, sf_dir).select("item_id", "class", "source_file", F.explode("fields").alias("f")).select("item_id", "class", "source_file", "f.name", C("f.field_type").alias("type"), C("f.value.value").cast("long").alias("value"))


@query("smali_label_join", """select item_id, 'VJL' as shorty, 5::int as registers, unnest([0, 1, 2, 3, 4, 5]) as place, unnest(['const/16', 'const-string', 'if-lez', 'add-int/lit8', 'goto', 'return-void']) as operation,
unnest([null, null, 5, null, 1, null]) as target, unnest([item_id % 1000, null, null, -1, null, null]) as literal, unnest([null, null, 'return-void', null, 'const-string', null]) as target_operation from benchmark""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = _smali(spark, sf_dir).select("item_id", F.explode("methods").alias("m")).select("item_id", C("m.prototype.shorty").alias("shorty"), "m.code.*")
    each = methods.select("item_id", "shorty", "registers", F.posexplode("instructions").alias("place", "i"), C("instructions.operation").alias("all"))
    return each.select("item_id", "shorty", "registers", "place", "i.operation", C("i.target_index").alias("target"), "i.literal", F.get("all", C("i.target_index")).alias("target_operation"))


@query("smali_catch", "select item_id, 'direct' as kind, 4::int as ins, 1::int as first, 5::int as last, 5::int as handler from benchmark")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = _smali(spark, sf_dir).select("item_id", F.explode("methods").alias("m"))
    return methods.select("item_id", "m.kind", C("m.code.ins").alias("ins"), F.inline("m.code.tries")).select("item_id", "kind", "ins", C("start_index").alias("first"), C("end_index").alias("last"), C("handler_index").alias("handler"))



# names and types of smali text
NAME = "[\\p{L}\\p{N}_$-]+"
over("smali_type_descriptors", "part", "p_partkey", "select p_partkey, 'Lpkg/P' || p_partkey || ';' as class_type, 'I' as element, 2::int as dimensions from part",
     class_type=lambda: G.parse(G.regex(f"L{NAME}(?:/{NAME})*;"), F.concat(F.lit("Lpkg/P"), C("p_partkey").cast("string"), F.lit(";"))), element=lambda: G.parse(G.object_({"_d": G.many("\\["), "t": G.regex("[ZBSCIJFDV]")}), F.lit("[[I"))["t"], dimensions=lambda: F.size(G.parse(G.object_({"d": G.many("\\["), "_t": G.regex("[ZBSCIJFD]")}), F.lit("[[I"))["d"]))
