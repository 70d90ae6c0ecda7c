"""Named queries over the driver tables and their SQL counterparts."""

from lavra.plans import queries  # noqa: F401  (first of all: it imports the other modules in their order)
