"""Road-condition analytics: operators."""
