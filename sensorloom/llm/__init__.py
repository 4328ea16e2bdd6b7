"""Operations of a large-scale training-data pipeline over text tables.

Nothing outside this subpackage imports it.  Each operator is a module with a
general interface (DataFrame in, DataFrame out); ``catalog`` registers one query
per operator.
"""
