"""Dalvik executables as tables: sections become DataFrames, and indices are resolved by joins on (file, index)."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from .relational import resolve

#: Values of many kinds stay JSON text; absent fields of an instruction are null.
NOTE = "visibility string, type_idx long, elements array<struct<name_idx long, value struct<type string, value string>>>"
CODE = (
    "struct<registers long, ins long, outs long, instructions array<struct<operation string, offset long, units long, a long, b long, c long, literal long, index long, target long, prototype long, registers array<long>>>,"
    "tries array<struct<start long, count long, handlers array<struct<type_idx long, address long>>, catch_all long>>,"
    "debug struct<line_start long, parameter_names array<long>, codes array<struct<op string, value long, register long, name_idx long, type_idx long, signature_idx long>>>>"
)
METHODS = f"array<struct<idx long, access_flags long, code {CODE}>>"
SCHEMA = (
    "string_ids array<struct<idx long, offset long>>, string_data array<struct<offset long, value string>>, type_ids array<struct<idx long, string_idx long>>,"
    "proto_ids array<struct<idx long, shorty_idx long, return_type_idx long, parameters array<long>>>, field_ids array<struct<idx long, class_idx long, type_idx long, name_idx long>>,"
    "method_ids array<struct<idx long, class_idx long, proto_idx long, name_idx long>>,"
    "class_defs array<struct<idx long, class_idx long, access_flags long, superclass_idx long, source_file_idx long, interfaces array<long>, static_values array<struct<type string, value string>>,"
    f"annotations struct<class array<struct<{NOTE}>>, fields array<struct<idx long, annotations array<struct<{NOTE}>>>>, methods array<struct<idx long, annotations array<struct<{NOTE}>>>>, parameters array<struct<idx long, annotations array<array<struct<{NOTE}>>>>>>,"
    f"data struct<static_fields array<struct<idx long, access_flags long>>, instance_fields array<struct<idx long, access_flags long>>, direct_methods {METHODS}, virtual_methods {METHODS}>>>"
)
NO_INDEX = 0xFFFFFFFF


def pool_of(operation: Column) -> Column:
    """The pool that an operation's index points into, null if none."""
    kinds = {"string": "^const-string", "type": "^(const-class|check-cast|instance-of|new-instance|new-array|filled-new-array)", "field": "^[is](get|put)", "method": "^invoke-(?!custom)"}
    return F.coalesce(*(F.when(operation.rlike(pattern), F.lit(name)) for name, pattern in kinds.items()))


class Executables:
    """The sections of many files. files: (file_id, content).

    Every section reads the parsed files, so they are kept on executors' disks and parsed once; lost blocks are parsed
    again. close() lets go of them.
    """

    def __init__(self, files: DataFrame, key: str = "file_id", column: str = "content") -> None:
        parsed = tables.parse_column(files.select(key, column), column, "dex", strict=True)
        self.key, self.all = key, parsed.select(key, F.from_json("value", SCHEMA).alias("x")).persist(StorageLevel.DISK_ONLY)

    def close(self) -> None:
        self.all.unpersist()

    def section(self, name: str) -> DataFrame:
        return self.all.select(self.key, F.inline(f"x.{name}"))

    def strings(self) -> DataFrame:
        return resolve(self.section("string_ids"), self.section("string_data").distinct(), "offset", "offset", "value", "string", [self.key]).select(self.key, "idx", "string")

    def types(self) -> DataFrame:
        return resolve(self.section("type_ids"), self.strings(), "string_idx", "idx", "string", "descriptor", [self.key]).select(self.key, "idx", "descriptor")

    def prototypes(self) -> DataFrame:
        p = resolve(self.section("proto_ids"), self.strings(), "shorty_idx", "idx", "string", "shorty", [self.key])
        p = resolve(p, self.types(), "return_type_idx", "idx", "descriptor", "returns", [self.key])
        each = p.select(self.key, "idx", F.posexplode("parameters").alias("i", "type_idx"))
        each = resolve(each, self.types(), "type_idx", "idx", "descriptor", "descriptor", [self.key])
        lists = each.groupBy(self.key, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "descriptor"))), lambda x: x["descriptor"]).alias("parameters"))
        return p.drop("parameters").join(lists, [self.key, "idx"], "left").select(self.key, "idx", "shorty", "returns", F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"))

    def fields(self) -> DataFrame:
        f = resolve(self.section("field_ids"), self.types(), "class_idx", "idx", "descriptor", "class", [self.key])
        f = resolve(f, self.types(), "type_idx", "idx", "descriptor", "type", [self.key])
        return resolve(f, self.strings(), "name_idx", "idx", "string", "name", [self.key]).select(self.key, "idx", "class", "type", "name")

    def methods(self) -> DataFrame:
        m = resolve(self.section("method_ids"), self.types(), "class_idx", "idx", "descriptor", "class", [self.key])
        m = resolve(m, self.strings(), "name_idx", "idx", "string", "name", [self.key])
        p = self.prototypes().withColumn("prototype", F.struct("shorty", "returns", "parameters"))
        return resolve(m, p, "proto_idx", "idx", "prototype", "prototype", [self.key]).select(self.key, "idx", "class", "name", "prototype.*")

    def classes(self) -> DataFrame:
        """Superclass and source file may be absent."""
        c = self.section("class_defs")
        c = resolve(c, self.types(), "class_idx", "idx", "descriptor", "class", [self.key])
        c = c.withColumns({n: F.when(F.col(n) != NO_INDEX, F.col(n)) for n in ("superclass_idx", "source_file_idx")})
        c = resolve(c, self.types(), "superclass_idx", "idx", "descriptor", "superclass", [self.key], optional=True)
        c = resolve(c, self.strings(), "source_file_idx", "idx", "string", "source_file", [self.key], optional=True)
        return c.select(self.key, "idx", "class", "access_flags", "superclass", "source_file", "data")

    def members(self) -> DataFrame:
        """(file, class, kind, name, access_flags) of all fields and methods that classes define, by one join with both pools."""
        kinds = {"static_fields": "field", "instance_fields": "field", "direct_methods": "method", "virtual_methods": "method"}

        def of(kind: str, pool: str) -> Column:
            return F.transform(F.col(f"data.{kind}"), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(pool).alias("pool"), m["idx"].alias("member_idx"), m["access_flags"].alias("access_flags")))

        each = self.classes().select(self.key, "class", F.inline(F.concat(*(of(*x) for x in kinds.items()))))
        names = self.fields().select(self.key, F.lit("field").alias("pool"), "idx", "name").union(self.methods().select(self.key, F.lit("method").alias("pool"), "idx", "name"))
        return resolve(each, names, "member_idx", "idx", "name", "name", [self.key, "pool"]).select(self.key, "class", "kind", "name", "access_flags")

    def bodies(self) -> DataFrame:
        """(file, method, registers, ins, outs, instructions, tries, debug) of all methods that have code."""
        c = self.section("class_defs")
        rows = c.select(self.key, F.explode(F.concat(F.coalesce("data.direct_methods", F.array()), F.coalesce("data.virtual_methods", F.array()))).alias("m"))
        return rows.where("m.code is not null").select(self.key, F.col("m.idx").alias("method_idx"), "m.code.*")

    def operands(self) -> DataFrame:
        """(file, pool, idx, operand): what an instruction's index may mean, in the text of each pool."""
        pools = {
            "string": self.strings().select(self.key, "idx", F.col("string").alias("operand")),
            "type": self.types().select(self.key, "idx", F.col("descriptor").alias("operand")),
            "field": self.fields().select(self.key, "idx", F.format_string("%s->%s:%s", "class", "name", "type").alias("operand")),
            "method": self.methods().select(self.key, "idx", F.format_string("%s->%s(%s)%s", "class", "name", F.array_join("parameters", ""), "returns").alias("operand")),
        }
        rows = [p.select(self.key, F.lit(n).alias("pool"), "idx", "operand") for n, p in pools.items()]
        return reduce(DataFrame.union, rows)

    def instructions(self) -> DataFrame:
        """(file, method_idx, place, operation, offset, units, registers, literal, target, pool, index, operand); one join for all pools.

        A pool's index without an entry ends the query; indices of call sites, method handles and prototypes have no pool.
        """
        each = self.bodies().select(self.key, "method_idx", F.posexplode("instructions").alias("place", "x"))
        each = each.select(self.key, "method_idx", "place", "x.*").withColumn("pool", pool_of(F.col("operation")))
        side = self.operands().select(F.col(self.key).alias("__file"), F.col("pool").alias("__pool"), F.col("idx").alias("__idx"), "operand")
        out = each.join(side, (each[self.key] == side["__file"]) & (each["pool"] == side["__pool"]) & (each["index"] == side["__idx"]), "left")
        found = F.when(F.col("pool").isNotNull() & F.col("operand").isNull(), F.raise_error(F.format_string("%s %d isn't in its pool", "pool", "index"))).otherwise(F.col("operand"))
        return out.select(self.key, "method_idx", "place", "operation", "offset", "units", "a", "b", "c", "registers", "literal", "target", "pool", "index", found.alias("operand"))

    def annotations(self) -> DataFrame:
        """(file, class, target, member_idx, parameter, visibility, type, elements): directory, sets and items of every class as rows."""
        c = resolve(self.section("class_defs"), self.types(), "class_idx", "idx", "descriptor", "class", [self.key]).select(self.key, "class", F.col("annotations").alias("d"))
        none = F.lit(None)
        rows = [c.select(self.key, "class", F.lit("class").alias("target"), none.cast("long").alias("member_idx"), none.cast("int").alias("parameter"), F.inline("d.class"))]
        for target in ("fields", "methods"):
            m = c.select(self.key, "class", F.explode(f"d.{target}").alias("m"))
            rows.append(m.select(self.key, "class", F.lit(target[:-1]).alias("target"), F.col("m.idx").alias("member_idx"), none.cast("int").alias("parameter"), F.inline("m.annotations")))
        p = c.select(self.key, "class", F.explode("d.parameters").alias("m")).select(self.key, "class", "m.idx", F.posexplode("m.annotations").alias("parameter", "s"))
        rows.append(p.select(self.key, "class", F.lit("parameter").alias("target"), F.col("idx").alias("member_idx"), "parameter", F.inline("s")))
        return resolve(reduce(DataFrame.union, rows), self.types(), "type_idx", "idx", "descriptor", "type", [self.key]).select(self.key, "class", "target", "member_idx", "parameter", "visibility", "type", "elements")
