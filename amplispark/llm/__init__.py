"""Operators for large text and sequence corpora; nothing else in the package imports this one."""
