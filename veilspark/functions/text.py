"""Unicode forms of texts. Python runs only on texts that aren't pure ASCII, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition."""
    import unicodedata

    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Compatibility composition and case folding."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def composed(text: Column) -> Column:
    """NFC."""
    return F.when(is_ascii(text), text).otherwise(nfc(F.when(~is_ascii(text), text)))


def folded(text: Column) -> Column:
    """NFKC, case folded."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(nfkc_casefold(F.when(~is_ascii(text), text)))
