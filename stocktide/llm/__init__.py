"""Operators for large text corpora: tokens, languages, duplicates, leaks and page text."""
