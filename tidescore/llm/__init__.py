"""Operators for preparing text for training language models. Nothing else in the library imports this subpackage."""
