"""The registered queries of the catalog engine; importing the package fills the registry."""

from . import catalog_queries, file_queries, retrieval_queries, source_queries, table_queries, task_queries  # noqa: F401
