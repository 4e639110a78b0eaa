"""Operators for training-data corpora: texts, token ids and vectors."""
