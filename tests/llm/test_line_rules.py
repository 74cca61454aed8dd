"""op1: figures against plain Python, rules line by line, odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F
from llm_cases import WORD, odd_rows, random_rows, table

from cellsight.llm import quality_rules as Q


def plain(text):
    w = WORD.findall(text or "")
    grams = list(zip(w, w[1:], w[2:]))
    twice = {g for g in grams if grams.count(g) > 1}
    inside = {p + k for p, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("rows", [[r for r in odd_rows() if r[0] != 12], random_rows(1), []])
def test_figures(spark, rows):
    out = Q.apply_rules(table(spark, rows)).collect()
    got = sorted((str(r.text), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted((str(r[1]), *plain(r[1])) for r in rows)


def test_every_word_repeated_in_a_long_text(spark):
    (r,) = Q.apply_rules(table(spark, [(12, "wort " * 30000, "de", "b")])).collect()
    assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept) == (30000, 30000, True, False)


def test_lines_are_judged_one_by_one(spark):
    good = "\n".join(" ".join(f"word{k}of{n}" for n in range(9)) + "." for k in range(8))
    bad = ["home | news | sport | shop", "HURRY!! BUY!! NOW!!", "we use cookies to improve this site.", "no end of a sentence here", "wow%%% such*** text$$$."]
    (r,) = Q.apply_rules(table(spark, [(1, good + "\n" + "\n".join(bad), "en", "a")])).collect()
    assert r.cleaned_text == good and r.kept and r.lost_chars == sum(len(b.replace(" ", "")) for b in bad)
    (r,) = Q.apply_rules(table(spark, [(1, "\n".join(bad * 12) + " x" * 3, "en", "a")])).collect()
    assert not r.kept


def test_sql_twin_on_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] != 12]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    got = Q.apply_rules(table(spark, rows)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(Q.SQL).fetchall()))


def test_phrases_in_any_ascii_case_and_counts_byte_by_byte(spark):
    """The search that comes before the pattern loses no phrase and adds none; counts by replacement equal plain ones."""
    lines = ["Please CLICK Here now.", "Please clic\u212a here now.", "All RIGHTS reserved \u0130stanbul.", "Nothing of it here.", "», | and • with > it.", "# * $ ok."]
    rows = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k int, line string")
    got = [r.good for r in rows.select("k", Q.good_line(F.col("line")).alias("good")).orderBy("k").collect()]
    assert got == [False, True, False, True, False, False]  # the last: more symbols than words
    counted = rows.select("line", Q.count_of(F.col("line"), Q.SEPARATORS + Q.SYMBOLS).alias("n"), Q.word_chars(F.col("line")).alias("w")).collect()
    assert all(r.n == sum(r.line.count(c) for c in set(Q.SEPARATORS + Q.SYMBOLS)) + sum(r.line.count(c) for c in set(Q.SEPARATORS) & set(Q.SYMBOLS)) for r in counted)
    assert all(r.w == len("".join(r.line.split(" "))) for r in counted)
