"""Operators for the texts of training data. Nothing outside this subpackage imports it."""
