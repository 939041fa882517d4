"""Readers and writers of the tab-separated tables; explicit schemas, columns found by name."""
