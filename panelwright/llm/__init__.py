"""Operators for text corpora and unkeyed records; nothing else in the library imports this package."""
