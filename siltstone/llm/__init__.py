"""Operators on keys and texts for training data; nothing else in the library imports this subpackage."""
