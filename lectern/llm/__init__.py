"""Operators for preparing training data from large text collections.

Each module holds one operator by its named method; ``queries`` gathers their queries. Nothing in
the rest of the library imports this subpackage.
"""
