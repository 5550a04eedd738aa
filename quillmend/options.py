"""Which repairs run, and which cut-off values are kept."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntFlag
from types import SimpleNamespace


class Allow(IntFlag):
    """Cut-off values that are kept (fixed values)."""

    NOTHING = 0
    STR = 1
    NUM = 2
    ARR = 4
    OBJ = 8
    KEY = 16
    BOOL = 32
    NULL = 64
    ATOM = 96
    COLLECTION = 12
    ALL = 127


class Repairs(IntFlag):
    """Repair passes (fixed values)."""

    NONE = 0
    FENCES = 1
    COMMENTS = 2
    UNQUOTED = 4
    KEYWORDS = 8
    NUMBERS = 16
    CONCATENATION = 32
    CALLS = 64
    ENTITIES = 128
    QUOTES = 256
    WHITESPACE = 512
    TRUNCATION = 1024
    NDJSON = 2048
    ALL = 4095


#: The same bits as plain integers, for the kernel: an enum's own operators are several times slower.
KEEP = SimpleNamespace(**{name: int(bit) for name, bit in Allow.__members__.items()})
PASS = SimpleNamespace(**{name: int(bit) for name, bit in Repairs.__members__.items()})


@dataclass(frozen=True)
class Options:
    """A pair of masks. Masks combine with ``|``, ``&`` and ``& ~``; bits beyond the known ones are ignored."""

    allow: int = int(Allow.ALL)
    repairs: int = int(Repairs.ALL)

    @classmethod
    def all(cls) -> Options:
        return cls()

    @classmethod
    def strict(cls) -> Options:
        return cls(int(Allow.ALL), int(Repairs.NONE))

    @classmethod
    def partial(cls, allow: int) -> Options:
        return cls(int(allow), int(Repairs.ALL))

    def with_repairs(self, repairs: int) -> Options:
        return Options(self.allow, int(repairs))

    def with_allow(self, allow: int) -> Options:
        return Options(int(allow), self.repairs)

    def repairs_with(self, mask: int) -> bool:
        return self.repairs & mask == mask

    def allows(self, mask: int) -> bool:
        return self.allow & mask == mask
