"""Streaming of the tax-notice jobs."""
