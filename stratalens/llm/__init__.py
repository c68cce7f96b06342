"""Operators on the text corpus; nothing outside this folder imports it."""
