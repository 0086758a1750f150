"""Structured Streaming entry points (stateless column functions on
readStream; the incremental re-aim of chunked file reading)."""
from .clean_stream import clean_stream, start_clean_stream
