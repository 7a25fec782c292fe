"""Operators of a training-data pipeline: one module each, over tables of documents, pages and vectors."""
