"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; it can be removed whole.
Each module holds one operator with its general interface; ``queries`` derives
the registered ``opN_*`` queries from them.
"""
