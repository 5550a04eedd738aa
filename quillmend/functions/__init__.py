"""Column functions; ``register_all`` makes them SQL functions."""

from .columns import *  # noqa: F403
from .registry import register_all  # noqa: F401
