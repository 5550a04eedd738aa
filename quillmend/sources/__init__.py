"""Reading damaged JSON from files and writing canonical JSON."""

from .files import read_broken_json, write_json  # noqa: F401
