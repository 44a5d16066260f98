"""Operators for building training data from the memory graph and its documents."""
