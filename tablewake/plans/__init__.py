"""Whole jobs: from files to written tables."""
