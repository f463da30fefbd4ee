"""Operators for preparing training text: one module an operator, see :mod:`quillspark.llm.queries`."""
