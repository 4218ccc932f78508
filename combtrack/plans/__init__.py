"""The registered queries."""

from . import catalogue, seasons, surfaces  # noqa: F401  (they add to the catalogue)
