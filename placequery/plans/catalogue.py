"""All registered queries."""

from . import analysis_queries, descriptors, evaluation, mask_queries, retrieval, storage_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
