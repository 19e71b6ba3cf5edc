"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it.  ``queries.py`` holds the registered
``opN_<name>`` queries and ``oracles.py`` the SQL they are compared with.
"""
