"""Plans of the tax-notice jobs."""
