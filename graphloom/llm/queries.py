"""All queries of this subpackage, QUERIES, and the SQL of those that SQL can express, SQL."""

from graphloom.llm import q_docpairs, q_leakage, q_packing, q_parse, q_pii, q_similar, q_written  # noqa: F401
from graphloom.llm.registry import QUERIES, SQL  # noqa: F401
