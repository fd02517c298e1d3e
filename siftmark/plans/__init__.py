"""The search engine: how the operators are put together."""
