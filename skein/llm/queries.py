"""Queries of the llm operators and their SQL, gathered from one module per problem."""

from skein.llm import text_queries, vector_queries

QUERIES = {**vector_queries.QUERIES, **text_queries.QUERIES}
SQL = {**vector_queries.SQL, **text_queries.SQL}
