"""Operators for preparing large training corpora; nothing else in docsift imports this."""
