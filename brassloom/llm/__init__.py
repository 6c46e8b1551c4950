"""Operators for preparing training data: ten Spark jobs over documents, pages, chats and vectors.

Nothing outside this subpackage imports it. ``brassloom.llm.registry`` holds
the queries and their SQL.
"""
