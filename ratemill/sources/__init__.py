"""Readers, writers and views that bring data into the package's row shapes."""
