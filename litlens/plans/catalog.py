"""All core queries and their SQL twins, by name."""

from litlens.plans import reference, reporting  # noqa: F401  (reporting registers its queries)

QUERIES = dict(reference.QUERIES)
SQL: dict[str, str] = dict(reference.SQL)
