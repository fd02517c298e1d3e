"""Relational operators: chunking, lexical index, dense index, fusion, lookups."""
