"""Training-data operators: secrets, personal data, deduplication, language, sharding, archives, tokens.

Nothing outside this subpackage imports it; ``verdigris.llm.queries`` holds the registered queries.
"""
