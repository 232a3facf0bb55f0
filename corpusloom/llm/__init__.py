"""Operators for training-data pipelines (removable: nothing else imports it)."""
