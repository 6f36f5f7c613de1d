"""Relational operators over files-shaped DataFrames."""
