"""Fixed-length token encoding (F9): every text becomes windows of
``max_length`` token ids with an attention mask; nothing is cut off.

ids: 0 = padding, 1 = reserved for unknown tokens, any token
``2 + hash % id_space``.  The id is a function of the token alone, so no
vocabulary is fitted, joined or broadcast and no row is shuffled.

Defined results: a text without tokens (or null) gives one window of padding;
``n_tokens`` is the length of the whole text, on each of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..functions.text import split_clean

PAD_ID = 0
FIRST_ID = 2
ID_SPACE = 2 ** 31 - 1 - FIRST_ID
ID_SEED = 42


def token_id(token: Column, id_space: int = ID_SPACE) -> Column:
    return (F.pmod(hash_key(ID_SEED, token), F.lit(id_space)) + FIRST_ID).cast("int")


def encode_fixed_length(df: DataFrame, clean_col: str = "clean_text", id_col: str = "doc_id",
                        max_length: int = 128, id_space: int = ID_SPACE) -> DataFrame:
    """``id_col, chunk, input_ids, attention_mask, n_tokens``: chunk c holds the
    tokens from ``c * max_length`` on."""
    tokens = df.select(id_col, F.coalesce(split_clean(clean_col), F.array().cast("array<string>")).alias("_t"))
    last = F.greatest(F.ceil(F.size("_t") / F.lit(max_length)).cast("int") - 1, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last),
                          lambda c: F.slice(F.col("_t"), c * max_length + 1, F.lit(max_length)))
    w = tokens.select(id_col, F.size("_t").cast("int").alias("n_tokens"), F.posexplode(windows).alias("chunk", "_w"))
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - F.size("_w"))
    ids = F.concat(F.transform("_w", lambda t: token_id(t, id_space)), pad)
    mask = F.concat(F.array_repeat(F.lit(1), F.size("_w")), pad)
    return w.select(id_col, "chunk", ids.alias("input_ids"), mask.alias("attention_mask"), "n_tokens")
