"""Training-data pipeline operators.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` wraps them as the registered ``opN_`` queries.
"""
