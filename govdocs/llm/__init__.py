"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it; the driver glue adds its queries when it is there.
"""
