"""Part of crawlweave."""
