"""Place search: ranked name matches and a scored index."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions.text import PUNCTUATION, index_name, query_name, tokens


def _like(name: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(name).like(pattern), F.lit(False))


def name_rank(query: str, *names: Column) -> Column:
    """1 equal, 2 prefix, 3 contains, over several languages; ``%`` and ``_`` act as wildcards."""
    wanted = query.strip().lower()
    test = lambda make: _any([make(n) for n in names])
    return (
        F.when(test(lambda n: F.coalesce(F.lower(n) == wanted, F.lit(False))), 1)
        .when(test(lambda n: _like(n, wanted + "%")), 2)
        .when(test(lambda n: _like(n, "%" + wanted + "%")), 3)
    )


def literal_rank(query: str, *names: Column) -> Column:
    """The same ranks on literal text."""
    wanted = query.lower()
    low = [F.coalesce(F.lower(n), F.lit("")) for n in names]
    return (
        F.when(_any([n == wanted for n in low]), 1)
        .when(_any([n.startswith(wanted) for n in low]), 2)
        .when(_any([n.contains(F.lit(wanted)) for n in low]), 3)
    )


def _any(tests: list[Column]) -> Column:
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return hit


def search_places(places: DataFrame, query: str, rank: Column, limit: int = 15) -> DataFrame:
    """Best matches by rank and name. The limit is the feature: a result list."""
    if not query.strip():
        return places.withColumn("rank", F.lit(1)).where(F.lit(False))
    return places.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name_en", "type", "id").limit(limit)


def district_boxes(areas: DataFrame, names: tuple[str, str] = ("district_en", "district_ti")) -> DataFrame:
    """Districts as the union of their areas' boxes, by name pair."""
    return areas.groupBy(*names).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def search_index(places: DataFrame) -> DataFrame:
    """Normalised names and aliases, and name tokens. Persist this; searches then only scan it."""
    return (
        places.withColumn("name_norm", index_name(F.col("name")))
        .withColumn("aliases_norm", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), query_name))
        .withColumn("tokens", tokens(F.col("name_norm")))
    )


def score_search(index: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Scored matches: name prefix 100, alias prefix 80, name part 60, alias part 40, token prefix 30."""
    wanted = re.sub(r"\s+", " ", re.sub(PUNCTUATION, " ", query.lower().strip())).strip()
    if len(query) < 2 or not wanted:
        return index.withColumn("score", F.lit(0)).withColumn("match_type", F.lit("")).where(F.lit(False))
    q = F.lit(wanted)
    token_hit = F.exists("tokens", lambda t: _any([t.startswith(F.lit(w)) for w in wanted.split(" ")]))
    ladder = [
        (F.col("name_norm").startswith(q), 100, "name-prefix"),
        (F.exists("aliases_norm", lambda a: a.startswith(q)), 80, "alias-prefix"),
        (F.col("name_norm").contains(q), 60, "name-contains"),
        (F.exists("aliases_norm", lambda a: a.contains(q)), 40, "alias-contains"),
        (token_hit, 30, "token-match"),
    ]
    score, kind = F.when(F.lit(False), 0), F.when(F.lit(False), "")
    for test, points, name in ladder:
        score, kind = score.when(test, points), kind.when(test, name)
    found = index.withColumn("score", score).withColumn("match_type", kind).where("score IS NOT NULL")
    return found.orderBy(F.desc("score"), "name", "type", "id").limit(limit)


GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """Distinct runs of ``n`` characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))).otherwise(F.array().cast("array<string>"))


def postings(places: DataFrame, names: Sequence[str], key: Sequence[str] = ("type", "id")) -> DataFrame:
    """Inverted index ``gram, *key``: every run of one to ``GRAM`` characters of the lower-cased names, once for each place. Persist this."""
    low = [F.lower(n) for n in names]
    grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(n, F.lit(k)), F.array().cast("array<string>")) for n in low for k in range(1, GRAM + 1)])))
    return places.select(*key, F.explode(grams).alias("gram"))


def search_many(places: DataFrame, index: DataFrame, queries: DataFrame, names: Sequence[str], key: Sequence[str] = ("type", "id"), limit: int = 15) -> DataFrame:
    """``query_id, rank, *columns of places``: the best matches of every search text (``query_id, query``) by literal rank and name, in one job.

    A text's rarest gram, by the exact lengths of its postings, names the candidates; only these are ranked. Every place that holds
    the text holds that gram, so nothing is missed; a gram without postings ends its text at once. Empty texts find nothing.
    """
    key = list(key)
    asked = queries.select("query_id", F.lower("query").alias("_q")).where("trim(_q) <> ''")
    wanted = asked.select("query_id", F.explode(_grams(F.col("_q"), F.least(F.lit(GRAM), F.length("_q")))).alias("gram"))
    lengths = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = wanted.join(lengths, "gram", "left")
    rarest = counted.groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("query_id", "g.gram")
    candidates = rarest.join(index, "gram").select("query_id", *key)
    met = candidates.join(places, key).join(asked, "query_id")
    low = [F.coalesce(F.lower(n), F.lit("")) for n in names]
    rank = F.when(_any([n == F.col("_q") for n in low]), 1).when(_any([F.startswith(n, F.col("_q")) for n in low]), 2).when(_any([F.contains(n, F.col("_q")) for n in low]), 3)
    ranked = met.withColumn("rank", rank).where("rank IS NOT NULL")
    order = W.partitionBy("query_id").orderBy("rank", names[0], *key)
    best = ranked.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
    return best.select("query_id", "rank", *places.columns)
