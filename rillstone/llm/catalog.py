"""The modules with queries of this subpackage."""

from rillstone.llm import algorithm_queries, text_queries

MODULES = [algorithm_queries, text_queries]
