"""Every registered query; importing a family registers it."""

from kickline.queries.base import ORACLE, QUERIES  # noqa: F401
from kickline.queries import windows, joins, aggregates, columns, scores, quality, ratings, gold, sources, learning, streams  # noqa: F401
