"""Operators on text and sequences for training data.  Nothing outside this subpackage imports it."""
