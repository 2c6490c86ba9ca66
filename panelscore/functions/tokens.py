"""Tokenisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token rule of the keyword matcher: letters and digits of any script, lower-cased; runs
# of anything else separate tokens, tokens shorter than 3 are dropped.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
MIN_TOKEN_LEN = 3


def token_array(text: Column) -> Column:
    """All pieces of ``text`` in order (short pieces still included; see ``is_token``)."""
    return F.split(F.lower(text), TOKEN_SPLIT)


def is_token(piece: Column) -> Column:
    """Row filter applied after ``explode`` (a plain, code-generated predicate)."""
    return F.length(piece) >= MIN_TOKEN_LEN


