"""Text functions as columns, and the fixed texts that reports and prompts are made of."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import let, whole_json

# Results must carry these texts as they are.
KB_QUERY = "%s architecture %s threat vulnerability mitigation. Attack vector: %s. NIST OWASP security controls guidelines."
TOPOLOGY_TITLE = "Architecture Topology Context:\n"
BOUNDARY_TITLE = "Architecture Visual Trust Boundaries:\n"
FALLBACK_CITATION = "Extracted via regex fallback"
FENCE, JSON_FENCE = "```", "```json"
#: Texts whose case folding is lower case with ß as ss (micro sign, dotted capital I, ŉ and long s are not of these).
FOLDS_ALIKE = r"^[\x00-\x1B\x20-\x84\x86-\xB4\xB6-\u012F\u0131-\u0148\u014A-\u017E\u2010-\u2027\u2030-\u205E\u20A0-\u20C0]*$"


def strip(c: Column) -> Column:
    """White space off both ends, as Unicode has it."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


@F.pandas_udf(T.StringType())
def normalize_any(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(x.casefold().split()))


def normalize_text(c: Column) -> Column:
    """Case folded, white space runs made one space. Letters up to U+017E fold by lower case, but for ß, ŉ and ſ, and so do
    signs that have no case; a text with anything else goes to ``normalize_any``, which folds every script."""
    return F.when(c.rlike(FOLDS_ALIKE), _folded(c)).otherwise(normalize_any(F.when(~c.rlike(FOLDS_ALIKE), c)))


def _folded(c: Column) -> Column:
    return strip(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def with_normalized(d: DataFrame, **columns: Column) -> DataFrame:
    """``d`` with ``normalize_text`` of some columns. Only rows that need it go through Python workers; the others are read apart."""
    easy = reduce(and_, [c.isNull() | c.rlike(FOLDS_ALIKE) for c in columns.values()])
    return d.filter(easy).withColumns({n: _folded(c) for n, c in columns.items()}).unionByName(d.filter(~easy).withColumns({n: normalize_any(c) for n, c in columns.items()}))


def canonical_name(c: Column) -> Column:
    return F.upper(strip(c))


def embed_text(title: Column, rule: Column) -> Column:
    return F.concat(title, F.lit(": "), rule)


def component_text(name: Column, kind: Column, labels: Column) -> Column:
    return F.concat(name, F.lit(" ("), kind, F.lit("): "), F.array_join(labels, "; "))


def budget(c: Column, chars: int) -> Column:
    """The first characters of a prompt's part."""
    return F.substring(c, 1, chars)


def edge_text(source: Column, relation: Column, target: Column, description: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit("] --("), relation, F.lit(")--> ["), target, F.lit("]: "), F.coalesce(description, F.lit("None")))


def boundary_sentence(name: Column, kind: Column, members: Column) -> Column:
    return F.concat(F.lit("- The '"), name, F.lit("' ("), kind, F.lit(") explicitly contains: "), members, F.lit(".\n"))


def kb_query_text(component: Column, category: Column, vector: Column) -> Column:
    return F.format_string(KB_QUERY, component, category, budget(vector, 50))


def clean_llm_json(c: Column) -> Column:
    """Without a code fence around it; the last three characters go with the first fence, closed or not."""
    s = strip(c)
    n = F.length(s)
    return strip(
        F.when(s.startswith(JSON_FENCE), F.substring(s, F.lit(8), F.greatest(n - 10, F.lit(0))))
        .when(s.startswith(FENCE), F.substring(s, F.lit(4), F.greatest(n - 6, F.lit(0))))
        .otherwise(s)
    )


def fenced(c: Column, fence: str) -> Column:
    """What stands between the first ``fence`` and the next bare one; up to the last but one character without."""

    def behind(rest: Column) -> Column:
        close = lambda at: F.substring(rest, F.lit(1), F.when(at > 0, at - 1).otherwise(F.greatest(F.length(rest) - 1, F.lit(0))))
        return strip(let(F.locate(FENCE, rest), close))

    return let(F.substring(c, F.locate(fence, c) + len(fence), F.length(c)), behind)


def closed(c: Column, fence: str) -> Column:
    """Whether a bare fence follows the first ``fence``."""
    start = F.locate(fence, c) + len(fence)
    return (F.locate(fence, c) > 0) & (F.locate(FENCE, F.substring(c, start, F.length(c))) > 0)


def fenced_json(c: Column) -> Column:
    """The part of a reply to read as JSON: in a json fence, else in a bare one, else all."""
    return F.when(F.locate(JSON_FENCE, c) > 0, fenced(c, JSON_FENCE)).when(F.locate(FENCE, c) > 0, fenced(c, FENCE)).otherwise(c)


def says_valid(c: Column) -> Column:
    """Whether a reply that is not JSON still says so."""
    low = F.lower(c)
    return low.contains("is_valid: true") | low.contains('"is_valid": true')


def is_json(c: Column) -> Column:
    """Whether all of a text is one JSON value."""
    return whole_json(c).isNotNull()


def truthy(v: Column) -> Column:
    """How a dynamic language would read a JSON value as a condition (a variant; null is false)."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", F.length(text) > 0)
        .when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}").otherwise(F.try_to_number(text, F.lit("9" * 18)) != 0)
    )


def key_id(*parts: Column) -> Column:
    """An id that follows from a row's natural key, so that reruns agree; null parts count as such."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def data_url(content: Column, kind: str = "image/png") -> Column:
    """Bytes as a data URL, on one line."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), "\\s", ""))


def json_dump(c: Column) -> Column:
    """A struct, map or array as JSON over many lines, indented by two."""
    return F.regexp_replace(F.to_json(c, {"pretty": "true"}), r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")
