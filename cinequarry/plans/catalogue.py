"""All registered queries of the library itself."""

from . import cache, curation, metrics, packing, sampling, similarity, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
