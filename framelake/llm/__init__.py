"""Operators for preparing training data: counting, formatting, storing, searching and filtering text."""
