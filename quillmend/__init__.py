"""quillmend: repair, extract, parse, validate and stream almost-JSON text on Spark."""

from .options import Allow, Options, Repairs

__all__ = ["Allow", "Options", "Repairs"]
