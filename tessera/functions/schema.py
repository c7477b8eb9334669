"""Whole texts as JSON, and replies checked against a schema: typed values, or the path of the first violation.

A schema is a ``Str``, ``Int``, ``List`` or ``Object``; an object lists its fields. Checks and values are expressions on
variants, so nothing leaves the JVM. Keys that a schema does not name are ignored. An object that names a key twice is no
JSON here, and neither are NaN and Infinity.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands behind a text while it is parsed; a text that holds it is no JSON here.
END = "\u0001end of text\u0001"
_END_JSON = '"\\u0001end of text\\u0001"'


def let(v: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def with_once(d: DataFrame, name: str, c: Column) -> DataFrame:
    """``d`` with a column that is worked out once a row. An optimizer puts the expression of a plain column into every filter and
    expression that names it, and of columns over columns a power of that; it does not look into the items of an exploded list."""
    return d.select("*", F.explode(F.array(c)).alias(name))


def whole_json(c: Column) -> Column:
    """A text as a variant if all of it is one JSON value, else null. A JSON null is a variant, not a null.

    A parser of one value does not look behind it. So the text becomes the first of two items of a list: what closes the
    list early, or adds items, is seen, as the second item is not the last.
    """

    def read(v: Column) -> Column:
        two = (F.try_variant_get(v, "$[1]", "string") == END) & F.try_variant_get(v, "$[2]", "variant").isNull()
        return F.when(two, F.try_variant_get(v, "$[0]", "variant"))

    list_of = lambda t: F.try_parse_json(F.concat(F.lit("["), t, F.lit(f",{_END_JSON}]")))
    return let(c, lambda t: F.when(~t.contains(END) & ~t.contains(_END_JSON), let(list_of(t), read)))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def items(v: Column) -> Column:
    return F.when(is_list(v), v.try_cast("array<variant>"))


def get(v: Column, name: str) -> Column:
    """A key's value; null where the key is not there, a variant where its value is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _wrong(path: Column, what: str) -> Column:
    return F.concat(path, F.lit(f": {what} expected"))


@dataclass(frozen=True)
class Str:
    sql = "string"

    def violation(self, v: Column, path: Column) -> Column:
        return F.when(F.coalesce(kind(v) != "STRING", F.lit(True)), _wrong(path, "string"))


@dataclass(frozen=True)
class Int:
    """Whole numbers: also 5.0, "5" and true, as lenient validators have it; not 5.5, and none beyond 32 bits."""

    sql = "int"

    def violation(self, v: Column, path: Column) -> Column:
        number = lambda t: t.try_cast("decimal(38,10)")
        whole = lambda t: F.coalesce((number(t) == F.floor(number(t))) & number(t).try_cast("int").isNotNull(), F.lit(False))
        text = F.try_variant_get(v, "$", "string")
        fits = lambda k: F.when(k == "BOOLEAN", True).when(k == "STRING", text.rlike(r"^[+-]?[0-9]+([.]0+)?$") & whole(text)).when(k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL"), whole(text)).otherwise(False)
        return F.when(~let(kind(v), fits), _wrong(path, "whole number"))


@dataclass(frozen=True)
class Field:
    """A key of an object. ``required`` keys must be there; the others may be missing, and null only where ``nullable``."""

    name: str
    of: object
    required: bool = True
    nullable: bool = False


@dataclass(frozen=True)
class List:
    of: object

    @property
    def sql(self) -> str:
        return f"array<{self.of.sql}>"

    def violation(self, v: Column, path: Column) -> Column:
        one = lambda x, i: self.of.violation(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        found = F.filter(F.transform(v.try_cast("array<variant>"), one), lambda x: x.isNotNull())
        return F.when(~is_list(v), _wrong(path, "list")).otherwise(F.get(found, F.lit(0)))


@dataclass(frozen=True)
class Object:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    @property
    def sql(self) -> str:
        return "struct<" + ",".join(f"{f.name}:{f.of.sql}" for f in self.fields) + ">"

    def violation(self, v: Column, path: Column) -> Column:
        """The first field that is wrong, in the order of the schema."""

        def one(f: Field) -> Column:
            at = F.concat(path, F.lit(f".{f.name}"))
            missing = F.concat(at, F.lit(": missing")) if f.required else F.lit(None).cast("string")

            def check(x: Column) -> Column:
                wrong = f.of.violation(x, at)
                return F.when(x.isNull(), missing).otherwise(F.when(kind(x) != "VOID", wrong) if f.nullable else wrong)

            return let(get(v, f.name), check)

        return F.when(~is_object(v), _wrong(path, "object")).otherwise(reduce(lambda a, b: F.coalesce(a, b), map(one, self.fields)))


def violation(v: Column, schema: Object) -> Column:
    """Null for a variant that fits, else where and how it first does not; ``$`` is the whole. A null is no JSON."""
    return F.when(v.isNull(), F.lit("$: not JSON")).otherwise(let(v, lambda x: schema.violation(x, F.lit("$"))))


def value(v: Column, schema: Object) -> Column:
    """The typed value of a variant that fits; keys that are not there are null."""
    return F.try_variant_get(v, "$", schema.sql)
