"""The registered queries outside the ``llm`` subpackage, and their SQL."""
