"""Readers and writers of ledgers, statements and pages."""
