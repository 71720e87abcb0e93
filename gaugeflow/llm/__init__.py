"""Operators of a training-data pipeline: filters, deduplication, mixing, formatting and derivatives.

Nothing outside this subpackage imports it; `gaugeflow.llm.queries` registers its queries.
"""
