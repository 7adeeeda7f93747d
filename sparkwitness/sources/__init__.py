"""Readers, writers and admission of documents."""
