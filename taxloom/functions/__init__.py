"""Functions of the tax-notice jobs."""
