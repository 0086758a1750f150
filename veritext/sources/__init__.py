"""Scans (S1-S14) and sinks (K1-K4)."""
from .tables import read_table, labelled_corpus, prediction_table_lineitem, prediction_table_docs
