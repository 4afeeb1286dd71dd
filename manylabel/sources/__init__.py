"""Readers and writers for catalogues, pages, datasets, labels and reports."""
