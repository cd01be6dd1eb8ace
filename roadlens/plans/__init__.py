"""Road-condition analytics: plans."""
