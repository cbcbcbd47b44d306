"""Operators over training text: filtering, duplicates, tokens, chat records."""
