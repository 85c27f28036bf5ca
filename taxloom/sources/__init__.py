"""Sources of the tax-notice jobs."""
