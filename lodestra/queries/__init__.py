"""The registered queries: importing this package registers them all."""

from lodestra.queries import features, nested, relational, scalars, statements  # noqa: F401
