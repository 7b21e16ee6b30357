"""Quillspark: search, reading and quality checks over text corpora, as Spark plans."""
