"""Training-data operators: ten stand-alone corpus operators on DataFrames.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` wraps them as the thin ``opN_<name>``
queries.
"""
