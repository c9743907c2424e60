"""Operators of a large-scale training-data pipeline.

Each module holds one operator with a general interface; :mod:`fathomline.llm.queries` binds them to the
tables of a data folder. Nothing outside this package imports it.
"""
