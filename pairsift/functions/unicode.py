"""The two text rules Spark has no built-in for: NFC and HTML5 entities.

A UDF inside ``when`` is still evaluated for every row, so the guard is moved into the
argument: rows that need nothing reach Python as nulls, which cost next to nothing.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairsift.functions.text import has_non_ascii

# characters below U+0300 and plain punctuation/currency are always in NFC already
SAFE = r"[\x00-\x{02FF}\x{2002}-\x{206F}\x{20A0}-\x{20BF}]"


def may_need_nfc(x: Column) -> Column:
    """Three tests from cheap to dear; ``AND`` stops at the first that fails."""
    return has_non_ascii(x) & x.rlike(r"[^\x00-\x{02FF}]") & x.rlike(SAFE.replace("[", "[^", 1))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def nfc(x: Column) -> Column:
    return F.coalesce(_nfc(F.when(may_need_nfc(x), x)), x)


def html_unescape(x: Column) -> Column:
    return F.coalesce(_unescape(F.when(x.contains("&"), x)), x)
