"""Operators for preparing training corpora: ten named methods over tables of texts, pages and vectors."""
