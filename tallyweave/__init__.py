"""Tallyweave: a PySpark-native engine for code-and-document workspaces.

The core packages hold the retrieval, link, duplicate, dependency, domain and
statistics operators. The optional subpackage of training-data operators is
never imported from here.
"""

__version__ = "0.1.0"
