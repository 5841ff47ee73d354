"""Operators for preparing text training data. Nothing outside this subpackage imports it."""
