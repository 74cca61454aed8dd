"""Name normalisation, identifiers and format checks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of identifiers and the punctuation treated as a space.
RELEASE_ID = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{6}Z(?:-[a-z0-9][a-z0-9-]*)?$"
PUNCTUATION = r"""['"(),.;:/\\-]"""


def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda text: unicodedata.normalize("NFKD", text), na_action="ignore")


def _nfkd(text: Column) -> Column:
    # Spark has no Unicode normalisation; built per call because it needs a running session.
    return F.pandas_udf(_decomposed, "string")(text)


def index_name(name: Column) -> Column:
    """Index form: compatibility decomposition, lower case, trimmed, single spaces.

    The decomposition is the one Python step of the library. It gets NULL for plain ASCII names,
    so their text is not sent to the worker.
    """
    decomposed = F.coalesce(_nfkd(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name)
    return F.trim(F.regexp_replace(F.trim(F.lower(decomposed)), r"\s+", " "))


def query_name(text: Column) -> Column:
    """Query form: lower case, punctuation to spaces, single spaces, trimmed."""
    spaced = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: F.length(t) > 0)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters to one dash, no outer dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def is_release_id(text: Column) -> Column:
    return text.rlike(RELEASE_ID)


def area_identity(prefix: str, source: str, key: Column, name: Column, district: Column, fingerprint: Column) -> Column:
    """Surrogate id over an unreliable source key: prefix + md5 of the joined parts."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tidy = lambda c: F.upper(F.trim(blank(c)))
    joined = F.concat_ws("|", F.lit(source), blank(key), tidy(name), tidy(district), fingerprint)
    return F.concat(F.lit(prefix), F.md5(joined))


def epsg_code(text: Column) -> Column:
    """32637, '32637' or 'EPSG:32637' to an integer; NULL when it is none of these."""
    bare = F.trim(F.regexp_replace(F.upper(F.trim(text.cast("string"))), "^EPSG:", ""))
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int"))
