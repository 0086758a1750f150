"""Column-expression building blocks (pure Catalyst, no UDFs)."""
from .text import (clean_text, word_count, char_length, tokens, drop_stopwords,
                   normalise_source_key, safe_name, DEFAULT_STOPWORDS)
from .hashing import unit_hash, hash_key
