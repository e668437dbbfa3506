"""Training-data operators: formatting, tokens, quality, duplicates, privacy, leaks.

Nothing else in the package imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` binds them to the
synthetic tables.
"""
