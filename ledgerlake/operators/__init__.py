"""Relational operators over files, digests and catalogs."""
