"""Readers and writers: Markdown files, bundles, document archives, logs, tables."""
