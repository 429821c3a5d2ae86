"""Operators for preparing training text: quality, language, duplicates, extraction, tokens, packing, mixing."""
