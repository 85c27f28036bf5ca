"""Operators of the tax-notice jobs."""
