"""Operators on text and on samples for training data. Nothing outside this subpackage imports it."""
