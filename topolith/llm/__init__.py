"""Operators for large text corpora.

Nothing else in the library imports this subpackage; its queries are listed in
``registry`` and the entry module adds them when the subpackage is present.
"""
