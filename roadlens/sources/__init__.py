"""Road-condition analytics: sources."""
