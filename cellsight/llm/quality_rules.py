"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text go.

Everything is a column expression on the row of the document: no shuffle, no Python.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.llm.common import SPACES, let, words

SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"""[.!?…。:;]["'”’»)\]]*($|\s)"""
SEPARATORS = "|»•>"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "use cookies", "enable javascript",
    "click here", "sign up for our newsletter", "subscribe to our", "back to top", "skip to content", "lorem ipsum",
)
BOILERPLATE_PATTERN = "(?i)(" + "|".join(BOILERPLATE) + ")"
MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST_PCT = 50, 50, 50


def count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are among ``chars``; taking out one character after the other is a search of bytes, ``translate`` looks every one up."""
    held = lambda c: ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / len(c.encode())).cast("int")
    return reduce(operator.add, map(held, chars))


def word_chars(text: Column) -> Column:
    return F.length(text) - count_of(text, SPACES)


def has_word(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES)) != ""


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``w``.

    Windows are sorted as (hash, position) longs; only windows whose shortened hash occurs twice are
    compared word by word, so the count is exact and the common case costs one sort of longs.
    """
    def of(v):
        n = F.size(v)
        bits = F.length(F.bin(n))
        key = lambda i: F.expr("0L") + F.call_function("shiftleft", F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)), bits).bitwiseOR(i.cast("long"))
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))
        high = lambda k, i: F.call_function("shiftright", F.get(k, i), bits)
        same = lambda k, i: ((i > 0) & (high(k, i - 1) == high(k, i))) | ((i < F.size(k) - 1) & (high(k, i + 1) == high(k, i)))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        maybe = let(keys, lambda k: F.filter(F.transform(k, lambda x, i: F.when(same(k, i), x.bitwiseAND(mask).cast("int"))), lambda p: p.isNotNull()))
        window = lambda p: F.struct(F.struct(F.get(v, p), F.get(v, p + 1), F.get(v, p + 2)).alias("w"), p.alias("p"))
        equal = lambda s, i: ((i > 0) & (F.get(s, i - 1)["w"] == F.get(s, i)["w"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["w"] == F.get(s, i)["w"]))
        sure = let(F.sort_array(F.transform(maybe, window)), lambda s: F.filter(F.transform(s, lambda x, i: F.when(equal(s, i), x["p"])), lambda p: p.isNotNull()))
        start = F.struct(F.lit(-10).alias("e"), F.lit(0).cast("long").alias("c"))
        step = lambda s, p: F.struct((p + 3).alias("e"), (s["c"] + F.least(F.lit(3), p + 3 - s["e"]).cast("long")).alias("c"))
        return F.when(n >= 3, F.aggregate(F.sort_array(sure), start, step, lambda s: s["c"])).otherwise(F.lit(0).cast("long"))

    return let(w, of)


def good_line(line: Column) -> Column:
    """The three rules of a line that has words: punctuation, navigation, boilerplate."""
    def of(trimmed):
        n = count_of(trimmed, " ") + 1
        doubled = (F.length(trimmed) - F.length(F.replace(trimmed, F.lit("!!"), F.lit("")))) / 2
        punctuation = trimmed.rlike(SENTENCE_END) & (doubled * 3 <= n) & (count_of(trimmed, "#*$%&<>") * 2 <= n)
        navigation = count_of(trimmed, SEPARATORS) < 3
        # few lines hold a phrase in any case, also of letters outside ASCII: only these are left to the pattern
        maybe = let(F.lower(trimmed), lambda low: reduce(operator.or_, [low.contains(phrase) for phrase in BOILERPLATE]))
        return punctuation & navigation & ~(maybe & trimmed.rlike(BOILERPLATE_PATTERN))

    return let(F.trim(line, F.lit(SPACES)), of)


def apply_rules(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, max_lost_pct: int = MAX_LOST_PCT) -> DataFrame:
    """``docs`` with word and line figures, ``cleaned_text`` and the verdict ``kept``.

    Lines are cut at ``\\n``. A line without words is neither good nor bad and stays. ``lost_chars`` are the word
    characters of removed lines; a document that loses more than ``max_lost_pct`` percent of its word characters
    is rejected. Null and empty texts have no words, fail the base rule and give an empty cleaned text. Repeated
    rows are judged one by one. Existing columns with the names of the results are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    figures = let(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = let(F.split(body, "\n", -1), lambda a: let(F.filter(a, has_word), lambda l: F.struct(
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        F.array_join(F.filter(a, lambda x: ~has_word(x) | good_line(x)), "\n").alias("cleaned_text"),
    )))
    out = docs.withColumns({"_figures": figures, "_lines": lines, "word_chars": word_chars(body).cast("long"), "n_symbols": count_of(body, SYMBOLS).cast("long")})
    out = out.withColumns({
        "n_words": F.col("_figures.n_words"), "n_repeat_words": F.col("_figures.n_repeat_words"),
        "n_dup_lines": F.col("_lines.n_dup_lines"), "cleaned_text": F.col("_lines.cleaned_text"),
    }).drop("_figures", "_lines")
    lost = F.col("word_chars") - word_chars(F.col("cleaned_text"))
    out = out.withColumn("lost_chars", F.when(F.col("cleaned_text") == body, F.lit(0).cast("long")).otherwise(lost))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_chars") <= max_lost_pct * F.col("word_chars")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def _sql_good(line: str) -> str:
    t = f"trim({line}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    n = f"(length({t}) - length(replace({t}, ' ', '')) + 1)"
    count = lambda chars: f"(length({t}) - length(translate({t}, '{chars}', '')))"
    ending = SENTENCE_END.replace("'", "''")
    return (f"(regexp_matches({t}, '{ending}') AND (length({t}) - length(replace({t}, '!!', ''))) / 2 * 3 <= {n} AND {count('#*$%&<>')} * 2 <= {n} "
            f"AND {count(SEPARATORS)} < 3 AND NOT regexp_matches({t}, '{BOILERPLATE_PATTERN}'))")


_CHARS = "length(translate({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT rid, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM g) WHERE k >= 2),
rep AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lf AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum({_CHARS.format("line")}) FILTER (NOT {_sql_good("line")}) AS lost
       FROM l WHERE {_CHARS.format("line")} > 0 GROUP BY rid),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, {_CHARS.format("t")}::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lf USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AND 100 * lost_chars <= {MAX_LOST_PCT} * word_chars AS kept, lost_chars
FROM f"""
