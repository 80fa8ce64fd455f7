"""Operators for preparing large text corpora for model training.

Every module holds one operator with a general DataFrame interface;
``queries`` applies each of them to the ``documents`` table.  Nothing outside
this package imports it.
"""
