"""Keys under which labels and messages are the same. NFKC and case folding have no built-in,
so these two run as Arrow UDFs; callers hand over the values that need it only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import ISOLATES, squeeze, strip

# ---- fixed values ----
VARIATION_SELECTORS = "[\ufe0e\ufe0f]"
NON_CONTACT_PREFIX = "(?U)^~[\\s\u202f\u00a0]*"
CHAIN_PLACEHOLDERS = (
    r"^(media|image|video|audio|sticker|gif|document|contact card|video note|voice message) omitted$"
    r"|^this message was deleted$|^you deleted this message$"
    r"|^missed (voice|video) call$|^null$|^attached .*$|^waiting for this message.*$"
)


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """NFKC, then case folding."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


def alias_key(label: Column) -> Column:
    """Lookup key of a sender label, alias or mention label."""
    bare = F.regexp_replace(F.regexp_replace(label, ISOLATES, ""), VARIATION_SELECTORS, "")
    return strip(folded(strip(F.regexp_replace(strip(bare), NON_CONTACT_PREFIX, ""))))


def without_signs(folded_text: Column) -> Column:
    """A folded text as chains compare it: no punctuation or plain symbols, emoji kept."""
    return squeeze(F.regexp_replace(folded_text, r"[\p{P}\p{Sm}\p{Sc}\p{Sk}]", ""))


def without_placeholders(bare: Column) -> Column:
    """The same with placeholders as empty texts."""
    return F.when(bare.rlike(CHAIN_PLACEHOLDERS), "").otherwise(bare)
