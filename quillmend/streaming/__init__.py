"""Documents that arrive in chunks, in batch and in Structured Streaming."""

from .fold import FoldProcessor, fold_batch, fold_lists, fold_state, fold_stream  # noqa: F401
