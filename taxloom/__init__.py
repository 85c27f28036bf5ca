"""Data jobs for indirect-tax notice practice on Spark."""
