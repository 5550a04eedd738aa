"""Operators on whole tables."""

from .tables import collect_array, collect_object, explode_spans, repaired  # noqa: F401
