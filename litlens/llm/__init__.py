"""Operators for training-text preparation; nothing outside this subpackage imports it."""
