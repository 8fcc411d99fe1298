"""Operators for preparing language-model training data.

Nothing outside this package imports it. Every operator takes and returns DataFrames, reads only
the columns named in its docstring (others may be present under any name) and keeps its
intermediate tables in the folder the session names in ``spark.checkpoint.dir``.
"""
