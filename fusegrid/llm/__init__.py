"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``registry.py`` lists its queries
for the entry module.
"""
