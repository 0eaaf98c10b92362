"""Operators for building training data. Nothing outside this subpackage imports it."""
