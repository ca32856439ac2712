"""Operators of large-scale training-data pipelines, each a DataFrame-to-DataFrame function.

Nothing outside this subpackage imports it; ``queries`` in ``tessera.llm.registry`` lists what the
repository's entry point registers.
"""
