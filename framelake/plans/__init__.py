"""Whole jobs: the stages from raw files to a submission."""
