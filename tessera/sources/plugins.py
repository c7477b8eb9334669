"""Outside models as functions over Arrow batches, with defaults that need none, and binary files by a parser."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 768
TEXT_BUDGET = 100_000


def isolated(call: Callable[[list], list], texts: list) -> list[tuple]:
    """(result, None) for each text, or (None, what went wrong): a batch that fails is halved until single texts fail, so one
    bad text costs about two calls for each halving, and no other text its result."""
    if not texts:
        return []
    try:
        got = list(call(texts))
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} replies to {len(texts)} texts")
        return [(x, None) for x in got]
    except Exception as e:  # whatever a model raises is a result of its text
        if len(texts) == 1:
            return [(None, str(e) or type(e).__name__)]
    half = len(texts) // 2
    return isolated(call, texts[:half]) + isolated(call, texts[half:])


def map_text(d: DataFrame, column: str, out: str, kind: str, call: Callable[[list[str]], list], error: str | None = None) -> DataFrame:
    """``d`` with ``out``: what ``call`` gives for a batch of texts; null texts give null. ``call`` must give the same
    for the same text, since a lost executor asks again. With ``error``, a column of that name, a failure of ``call`` is
    the result of the texts that it fails on; without, it ends the job."""

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            known = b[column].notna().to_numpy()
            texts = b.loc[known, column].tolist()
            if error:
                got = iter(isolated(call, texts))
                pairs = [next(got) if k else (None, None) for k in known]
                b[out], b[error] = [p[0] for p in pairs], pd.Series([p[1] for p in pairs], index=b.index, dtype="object")
            else:
                got = iter(call(texts) if texts else [])
                b[out] = [next(got) if k else None for k in known]
            yield b

    d = d.drop(out, error) if error else d.drop(out)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + [f"`{out}` {kind}"] + ([f"`{error}` string"] if error else [])
    return d.mapInPandas(run, ", ".join(fields))


def hash_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """A stand-in for an embedding model: words hashed to signed places, scaled to length one."""
    out = []
    for t in texts:
        v = np.zeros(dimensions, np.float32)
        for w in t.casefold().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        n = float(np.sqrt((v * v).sum()))
        out.append((v / n if n else v).tolist())
    return out


def embed(d: DataFrame, column: str = "text", out: str = "embedding", call: Callable[[list[str]], list] = hash_embedding) -> DataFrame:
    return map_text(d, column, out, "array<float>", call)


def line_requirements(texts: list[str]) -> list[str]:
    """A stand-in for an extraction model: each line with a colon is a title and a rule."""
    rows = [[{"title": a.strip(), "actionable_rule": b.strip()} for a, s, b in (x.partition(":") for x in t.split("\n")) if s and a.strip() and b.strip()] for t in texts]
    return [json.dumps({"requirements": r}) for r in rows]


def extract(d: DataFrame, column: str = "text", out: str = "reply", call: Callable[[list[str]], list] = line_requirements, chars: int = TEXT_BUDGET) -> DataFrame:
    """Replies for the first ``chars`` characters of each text."""
    return map_text(d.withColumn(column, F.substring(column, 1, chars)), column, out, "string", call)


def first_words(texts: list[str], words: int = 60) -> list[str]:
    return [" ".join(t.split()[:words]) for t in texts]


def summarise(d: DataFrame, column: str = "prompt_text", out: str = "summary", call: Callable[[list[str]], list] = first_words) -> DataFrame:
    return map_text(d, column, out, "string", call)


def binary_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_no, text) of binary documents; a file that ``parse`` fails on gives one row with its error."""

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    rows += [(p, i, t, None) for i, t in enumerate(parse(bytes(content)))]
                except Exception as e:  # a broken file is a result, not a failure of the job
                    rows.append((p, None, None, str(e)[:100]))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")


def binary_images(spark: SparkSession, path: str, parse: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(path, image_no, image) of the images inside binary documents; a file that ``parse`` fails on gives none."""

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                try:
                    images = parse(bytes(content))
                except Exception:  # as a file without images; its pages tell the error
                    images = []
                yield pd.DataFrame([(p, i, x) for i, x in enumerate(images)], columns=["path", "image_no", "image"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, image_no int, image binary")


def retried(call: Callable[[list[str]], list], attempts: int = 4, limited: type[Exception] = TimeoutError, failed: type[Exception] = ConnectionError,
            wait: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list]:
    """``call`` asked again: after 1, 2, 4, ... seconds when its rate is limited, after 2 when it fails, which the last
    attempt may not."""

    def run(texts: list[str]) -> list:
        for k in range(attempts):
            try:
                return call(texts)
            except limited:
                wait(2.0**k)
            except failed:
                if k == attempts - 1:
                    raise
                wait(2.0)
        raise RuntimeError("no reply after the last attempt")

    return run


def word_graph(texts: list[str]) -> list[str]:
    """A stand-in for a graph model: words in capitals are entities, and each is linked to the next."""
    out = []
    for t in texts:
        names = list(dict.fromkeys(w for w in t.split() if w.isalpha() and w.isupper() and len(w) > 1))
        edges = [{"source_entity": a, "target_entity": b, "relation_type": "NEXT_TO", "description": ""} for a, b in zip(names, names[1:])]
        out.append(json.dumps({"entities": [{"name": n, "type": "Word", "description": ""} for n in names], "edges": edges}))
    return out


def extract_graph(d: DataFrame, column: str = "text", out: str = "reply", call: Callable[[list[str]], list] = word_graph) -> DataFrame:
    return map_text(d, column, out, "string", call)


def no_diagram(images: list[bytes]) -> list[str]:
    """A stand-in for a vision model: nothing is shown."""
    return [json.dumps({"components": [], "data_flows": [], "trust_boundaries": []})] * len(images)


def read_diagrams(d: DataFrame, column: str = "image", out: str = "reply", call: Callable[[list[bytes]], list] = no_diagram) -> DataFrame:
    return map_text(d, column, out, "string", call)


def enrich(d: DataFrame, column: str = "prompt", out: str = "reply", call: Callable[[list[str]], list] | None = None) -> DataFrame:
    """Replies to report prompts; without a model there are none, and the basic report stands."""
    return map_text(d, column, out, "string", call or (lambda prompts: [None] * len(prompts)))
