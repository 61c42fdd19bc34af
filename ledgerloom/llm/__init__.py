"""Corpus-preparation operators.  Nothing else in the package imports this folder."""
