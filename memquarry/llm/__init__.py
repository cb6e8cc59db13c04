"""Operators for building training data from document tables; nothing else in memquarry imports this subpackage."""
