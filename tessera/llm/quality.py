"""Quality rules: line-first cleaning. Lines that fail a punctuation, navigation or boilerplate rule go first;
then documents that lost too much text are rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free

# Characters and phrases that the rules look for.
SYMBOLS = r"[#*$%&|<>]"
ENDINGS = r"[.!?…。！？][\"'”’»)\]]*(\s|$)"
SEPARATORS = r"[|»›·•]"
LOUD = r"!!|\?\?"
BOILERPLATE = (
    r"(?i)all rights reserved|licen[sc]ed under|released under|terms of (use|service)|privacy policy"
    r"|cookie policy|we use cookies|enable javascript|lorem ipsum|click here|sign in|log in|subscribe now|copyright ©"
)
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
MIN_WORDS = 50
MAX_LOST = 50  # per cent of a document's characters


def line_fails(line: Column) -> Column:
    """A line with words fails if no sentence ends in it, with a separator, symbol or loud mark to every few words,
    or with a phrase of boilerplate."""
    n = F.regexp_count(line, F.lit(WORD))
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) * 4 >= n
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 2 >= n
    loud = F.regexp_count(line, F.lit(LOUD)) * 2 >= n
    return ~line.rlike(ENDINGS) | navigation | symbols | loud | line.rlike(BOILERPLATE)


def quality(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    clean_text added (replacing columns of these names).

    Null and empty texts have no words and fail. A line that repeats an earlier one of its text is boilerplate
    too: only the first stays. Ties cannot occur; repeated rows each get their own result; an empty table gives
    an empty result. Texts of any length are read whole.
    """
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    chars = free("__chars", keep)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.struct(*keep, text.alias(free("__none", keep))).alias("__row"), text.alias("__t"))  # names inside a struct clash with none
    d = d.withColumn("__words", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    gram = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
        lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))).otherwise(F.array().cast("array<long>"))
    d = d.withColumn("__grams", gram)
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    d = d.withColumn("__sorted", F.when(repeats, F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    d = d.withColumn("__at", F.sort_array(F.transform(F.filter(
        F.transform("__sorted", lambda s, i: F.struct(s["i"].alias("i"), (
            s["g"].eqNullSafe(F.get("__sorted", i - 1)["g"]) | s["g"].eqNullSafe(F.get("__sorted", i + 1)["g"])).alias("hit"))),
        lambda s: s["hit"]), lambda s: s["i"])))
    covered = F.aggregate(F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn("__lines", lines)
    d = d.withColumn("__once", F.array_distinct("__lines"))
    d = d.select(
        *[F.col("__row").getField(c).alias(c) for c in keep], "n_words", F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size("__once")).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join(F.filter("__once", lambda x: ~line_fails(x)), "\n").alias("clean_text"),
        F.length("__t").alias(chars),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    lost = (F.col(chars) - F.length("clean_text")) * 100 > F.col(chars) * max_lost
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost).drop(chars)


def keep_quality(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that the rules keep, with their columns but those that ``quality`` replaces, their texts without the lines that failed.

    The verdict drops rows in a generator: a filter on it would be pushed down into the expressions that it is
    made of and evaluate them over and over.
    """
    d = quality(docs, text_col, **options)
    clean = F.explode(F.when(F.col("kept"), F.array("clean_text")).otherwise(F.array().cast("array<string>"))).alias("__clean")
    own = [c for c in docs.columns if c in d.columns and c not in ADDED]
    row = F.struct(*[c for c in own if c != text_col], F.lit(0).alias(free("__none", own))).alias("__row")
    d = d.select(row, clean)
    return d.select(*[F.col("__clean").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in own])
