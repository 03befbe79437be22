"""Readers and writers of documents, tables and facts."""
