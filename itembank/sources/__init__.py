"""Readers, writers and the derived tables the registered queries use."""
