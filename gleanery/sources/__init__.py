"""Readers, writers and the shared folder for tables that cut lineage."""
