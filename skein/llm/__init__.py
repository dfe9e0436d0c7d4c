"""Operators for text that goes into language models. Nothing else in the library imports this package."""
