"""Readers that turn directories and containers into tables."""
