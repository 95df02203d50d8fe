"""Rules that are expressions over columns."""
