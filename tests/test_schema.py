"""Whole texts as JSON against Python's own parser, and schemas by their first violation."""

import json

import pytest

from tessera.functions import llmjson
from tessera.functions.schema import Field, Int, List, Object, Str, violation, whole_json
from pyspark.sql import functions as F

TEXTS = ["1 x", "1], [2", "1, 2", '"x" y', ' {"a":1} ', "null", "", " ", '[1,null,"x"]', "{}", "tru", "true", '{"a":1}]', "[1,2", '{"a":1} {"b":2}', '1,"\x01end of text\x01"]', '1,"\\u0001end of text\\u0001"],[', "1e3", '{"a":"\\u0001"}',
         '{"a":"b\nc"}', "[1,]", "{'a':1}", "[[[[1]]]]", '"a" ', "\n3\n", "-0.5", "01", "nul"]


def test_whole_json(spark):
    got = {r.t: r.ok for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", whole_json(F.col("t")).isNotNull().alias("ok")).collect()}
    for t in TEXTS:
        try:
            json.loads(t)
            want = True
        except ValueError:
            want = False
        if "end of text" not in t:  # the mark itself is taken for no JSON
            assert got[t] is want, t
        else:
            assert got[t] is False


WHOLE = [("5", True), ("5.0", True), ('"5"', True), ('" 5.00 "', False), ('"5.00"', True), ("5.5", False), ('"x"', False), ("true", True), ("null", False), ("1e3", True), ('"1e3"', False), ("[5]", False), ("9223372036854775808", False)]


@pytest.mark.parametrize("text,fits", WHOLE)
def test_whole_numbers(spark, text, fits):
    v = whole_json(F.concat(F.lit('{"n":'), F.col("t"), F.lit("}")))
    r = spark.createDataFrame([(text,)], "t string").select(violation(v, Object((Field("n", Int()),))).alias("v")).first().v
    assert r == (None if fits else "$.n: whole number expected")


def test_first_violation(spark):
    item = Object((Field("a", Str()), Field("b", List(Str()), required=False), Field("c", Str(), required=False, nullable=True)))
    cases = {
        '[{"a":"x"}]': None, '[{"a":"x","c":null}]': None, '[{"a":"x","b":null}]': "$.all[0].b: list expected", '[{"a":"x","b":["y",2,3]}]': "$.all[0].b[1]: string expected",
        '[{"a":"x"},7]': "$.all[1]: object expected", '[{"a":null}]': "$.all[0].a: string expected", "[{}, 7]": "$.all[0].a: missing", '[{"a":"x","c":3}]': "$.all[0].c: string expected", "{}": "$.all: list expected", "[": "$: not JSON",
    }
    d = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("v", whole_json(F.concat(F.lit('{"all":'), F.col("t"), F.lit("}"))))
    got = {r.t: r.r for r in d.select("t", violation(F.col("v"), Object((Field("all", List(item)),))).alias("r")).collect()}
    assert got == cases


def test_diagram_defaults(spark):
    reply = '{"components":[{"name":"A","type":"T","coordinates":{"ymin":"1","xmin":2.0,"ymax":true,"xmax":4}}],"data_flows":[{"source":"A","target":"B","flow_label":"f"}],"more":1}'
    g = llmjson.diagram(spark.createDataFrame([(reply,)], "reply string")).first().g
    c = g.components[0]
    assert (c.coordinates.ymin, c.coordinates.xmin, c.coordinates.ymax, c.coordinates.xmax, c.labels_on_box) == (1, 2, 1, 4, [])
    assert (g.data_flows[0].direction, g.data_flows[0].protocol, g.trust_boundaries) == ("unidirectional", None, [])


def test_a_reply_is_parsed_a_fixed_number_of_times(spark):
    """However many columns and filters stand on a parsed reply, the plan parses the reply once, and once what its fence holds."""
    d = spark.createDataFrame([('{"recommendations":[{"threat_id":"T"}]}',), ('x ```json {"recommendations":[{"threat_id":"U"}]} ```',), (None,), ('{"recommendations":[1]}',)], "reply string")
    parses = lambda f: f._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson(")
    t = llmjson.recommendations(d)
    assert sorted(r.threat_id for r in t.collect()) == ["T", "U"]
    assert 1 <= parses(t) <= 2 and 1 <= parses(llmjson.report_header(d)) <= 2 and 1 <= parses(llmjson.threats(d)) <= 2
    assert parses(llmjson.feedback(d)) <= 2  # once in each of its two branches
    assert all(parses(f(d)) == 1 for f in (llmjson.requirements, llmjson.graph, llmjson.diagram))
