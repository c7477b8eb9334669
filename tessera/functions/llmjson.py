"""Model replies as typed rows: parsing, checks and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import Field, Int, List, Object, Str, get, is_list, is_object, items, kind, value, violation, whole_json, with_once
from .text import FALLBACK_CITATION, FENCE, JSON_FENCE, clean_llm_json, closed, fenced, fenced_json, says_valid, truthy

_NAMED = lambda *names: tuple(Field(n, Str()) for n in names)
_MAYBE = {"required": False, "nullable": True}
# The keys of replies and their types.
REQUIREMENTS = Object((Field("requirements", List(Object((*_NAMED("title", "actionable_rule"), Field("is_child_of", Str(), **_MAYBE), Field("db_id", Str(), **_MAYBE))))),))
GRAPH = Object((
    Field("entities", List(Object(_NAMED("name", "type", "description")))),
    Field("edges", List(Object(_NAMED("source_entity", "target_entity", "relation_type", "description")))),
))
DIAGRAM = Object((
    Field("components", List(Object((
        *_NAMED("name", "type"), Field("coordinates", Object(tuple(Field(n, Int()) for n in ("ymin", "xmin", "ymax", "xmax")))), Field("labels_on_box", List(Str()), required=False))))),
    Field("data_flows", List(Object((*_NAMED("source", "target", "flow_label"), Field("protocol", Str(), **_MAYBE), Field("direction", Str(), required=False))))),
    Field("trust_boundaries", List(Object((Field("boundary_name", Str()), Field("contained_components", List(Str())), Field("boundary_type", Str())))), required=False),
))


def checked(d: DataFrame, schema: Object, reply: str = "reply", out: str = "g") -> DataFrame:
    """With ``out``, the typed value of a reply that fits the schema, and ``reason``: null for those, else where and how a reply
    first does not fit. A reply is read without a code fence around it, and as a whole."""
    j = with_once(d, "__v", whole_json(clean_llm_json(F.col(reply))))
    j = with_once(j, "reason", violation(F.col("__v"), schema))
    return with_once(j, out, F.when(F.col("reason").isNull(), value(F.col("__v"), schema))).drop("__v")


def rejects(d: DataFrame, schema: Object, reply: str = "reply") -> DataFrame:
    """The replies that do not fit, with the reason."""
    return checked(d, schema, reply, "__g").filter("reason IS NOT NULL").drop("__g")


def requirements(d: DataFrame, reply: str = "reply") -> DataFrame:
    """The requirements of replies that fit the schema: (ord, title, actionable_rule, is_child_of)."""
    j = checked(d, REQUIREMENTS, reply, "__j").filter("reason IS NULL")
    return j.select(*d.columns, F.posexplode("__j.requirements").alias("ord", "r")).select(*d.columns, "ord", "r.title", "r.actionable_rule", "r.is_child_of")


def graph(d: DataFrame, reply: str = "reply") -> DataFrame:
    return checked(d, GRAPH, reply).filter("reason IS NULL").drop("reason")


def diagram(d: DataFrame, reply: str = "reply") -> DataFrame:
    """With defaults for keys that need not be there: no labels, one direction, no boundaries."""
    none = lambda c, kind_: F.coalesce(c, F.array().cast(kind_))
    g = checked(d, DIAGRAM, reply).filter("reason IS NULL").drop("reason")
    parts = F.transform("g.components", lambda x: x.withField("labels_on_box", none(x["labels_on_box"], "array<string>")))
    flows = F.transform("g.data_flows", lambda x: x.withField("direction", F.coalesce(x["direction"], F.lit("unidirectional"))))
    return g.withColumn("g", F.struct(parts.alias("components"), flows.alias("data_flows"), none(F.col("g.trust_boundaries"), DIAGRAM.fields[2].of.sql).alias("trust_boundaries")))


def _get(item: Column, keys: Column, name: str, default: Column) -> Column:
    """A missing key gives the default, a null stays null."""
    return F.when(F.array_contains(keys, name), F.get_json_object(item, f"$.{name}")).otherwise(default)


def _number(item: Column, keys: Column, name: str, default: str) -> Column:
    """A number, of a string too; true and false are 1 and 0."""
    v = _get(item, keys, name, F.lit(default))
    return F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))


def _as_text(v: Column, text: Column) -> Column:
    """How a dynamic language writes a value out: None, True and False; lists and objects stay JSON."""
    return F.when(kind(v) == "VOID", "None").when(kind(v) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _parsed(d: DataFrame, c: Column, inside: Column) -> DataFrame:
    """With __v: a text as JSON, else what stands in its fence. Each is parsed once."""
    j = with_once(d, "__w", whole_json(c))
    return with_once(j, "__v", F.coalesce("__w", whole_json(F.when(F.col("__w").isNull(), inside)))).drop("__w")


def threats(d: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows of a reply's list: the whole reply as JSON, else a json fence, else a bare one. A list with an item that is no object
    gives no rows at all; items with a number that is none or null are dropped, and default ids count accepted items."""
    c = F.col(reply)
    inside = F.when(F.locate(JSON_FENCE, c) > 0, fenced(c, JSON_FENCE)).when(F.locate(FENCE, c) > 0, fenced(c, FENCE))
    j = _parsed(d, c, inside)
    j = with_once(j, "__l", F.when(F.schema_of_variant("__v").startswith("ARRAY"), F.col("__v").try_cast("array<variant>"))).drop("__v").withColumnRenamed("__l", "__v")
    j = j.filter(~F.exists("__v", lambda x: ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))))
    items = F.transform("__v", lambda x, i: F.struct(i.alias("pos"), F.to_json(x).alias("item"), F.json_object_keys(F.to_json(x)).alias("keys")))
    items = F.transform(items, lambda x: x.withField("cvss_estimate", _number(x["item"], x["keys"], "cvss_estimate", "5.0")).withField("confidence", _number(x["item"], x["keys"], "confidence", "0.5")))
    items = F.filter(items, lambda x: x["cvss_estimate"].isNotNull() & x["confidence"].isNotNull())
    j = j.select(*d.columns, F.posexplode(items).alias("__n", "__x"))
    g = lambda n, default: _get(F.col("__x.item"), F.col("__x.keys"), n, default).alias(n)
    return j.select(
        *d.columns, F.col("__x.pos").alias("pos"), g("threat_id", F.format_string("T-%03d", F.col("__n") + 1)), g("category", F.lit("Elevation_of_Privilege")),
        g("target_component", F.lit("Unknown")), g("attack_vector", F.lit("")), "__x.cvss_estimate", "__x.confidence")


def feedback(d: DataFrame, reply: str = "reply") -> DataFrame:
    """A reply's object, or the first of its list, with defaults; a reply that is no JSON but says valid counts; others give no row."""
    j = with_once(d, "__v", whole_json(fenced_json(F.col(reply))))
    j = with_once(j, "__i", F.when(F.schema_of_variant("__v").startswith("ARRAY"), F.try_variant_get("__v", "$[0]", "variant")).otherwise(F.col("__v")))
    j = with_once(j, "item", F.to_json("__i"))
    j = with_once(j, "keys", F.json_object_keys("item"))
    g = lambda n, default: _get(F.col("item"), F.col("keys"), n, F.lit(default))
    # reasons and citations are texts whatever they are in the reply
    t = lambda n, default: _as_text(get(F.col("__i"), n), g(n, default)).alias(n)
    valid = F.when(F.array_contains("keys", "is_valid"), truthy(F.try_variant_get("__i", "$.is_valid", "variant"))).otherwise(True)
    parsed = j.filter(F.size("keys") > 0).select(
        *d.columns, valid.alias("is_valid"), t("validation_reason", "No reason provided"), g("adjusted_severity", "High").alias("adjusted_severity"), t("citation_reference", "Unknown"))
    said = j.filter(F.col("__v").isNull() & says_valid(F.col(reply))).select(
        *d.columns, F.lit(True).alias("is_valid"), F.substring(reply, 1, 200).alias("validation_reason"), F.lit("High").alias("adjusted_severity"), F.lit(FALLBACK_CITATION).alias("citation_reference"))
    return parsed.unionByName(said)


def _report(d: DataFrame, reply: str) -> DataFrame:
    """With __v: a report's object, the whole reply as JSON or else a closed json fence; null where there is none."""
    c = F.col(reply)
    j = _parsed(d, c, F.when(closed(c, JSON_FENCE), fenced(c, JSON_FENCE)))
    return with_once(j, "__o", F.when(is_object(F.col("__v")), F.col("__v"))).drop("__v").withColumnRenamed("__o", "__v")


def recommendations(d: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows of a report. Missing keys have defaults, and a null stays null; one citation that is no list is a list of one.

    A report that cannot be laid out gives no rows: one with an item that is no object, with a severity that is no text, or
    with citations that are a number or true.
    """
    severity, citations = (lambda r: get(r, "severity")), (lambda r: get(r, "citations"))
    odd = lambda r: ~is_object(r) | (kind(severity(r)) != "STRING") | ~(is_list(citations(r)) | kind(citations(r)).isin("VOID", "STRING") | ~truthy(citations(r)))
    j = with_once(_report(d, reply), "__r", items(get(F.col("__v"), "recommendations"))).filter(~F.exists("__r", lambda r: F.coalesce(odd(r), F.lit(False))))
    j = j.select(*d.columns, F.posexplode("__r").alias("pos", "__x"))

    def text(name: str, default: str) -> Column:
        v = get(F.col("__x"), name)
        return F.when(v.isNull(), F.lit(default)).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.when(kind(v) != "VOID", F.to_json(v)))).alias(name)

    c = get(F.col("__x"), "citations")
    some = F.transform(items(c), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    none = F.array().cast("array<string>")
    one = F.when(F.length(F.try_variant_get(c, "$", "string")) > 0, F.array(F.try_variant_get(c, "$", "string"))).otherwise(none)
    cited = F.when(c.isNull(), none).when(kind(c) == "VOID", F.lit(None)).when(is_list(c), some).when(kind(c) == "STRING", one).otherwise(none)
    return j.select(*d.columns, "pos", text("threat_id", ""), text("category", "Unknown"), text("target_component", "Unknown"), text("attack_vector", ""), text("severity", "High"),
                    text("mitigation_strategy", ""), cited.alias("citations"))


COUNTS = ("total_threats", "critical_count", "high_count", "medium_count")


def report_header(d: DataFrame, reply: str = "reply") -> DataFrame:
    """What a report says of itself, as text: executive_summary (null where there is none, or an empty one) and ``COUNTS`` (null
    where the report does not have the key)."""
    j = _report(d, reply).filter("__v IS NOT NULL")
    text = lambda n: _as_text(get(F.col("__v"), n), F.coalesce(F.try_variant_get(get(F.col("__v"), n), "$", "string"), F.to_json(get(F.col("__v"), n))))
    summary = F.when(truthy(get(F.col("__v"), "executive_summary")), text("executive_summary"))
    return j.select(*d.columns, summary.alias("executive_summary"), *[text(n).alias(n) for n in COUNTS])
