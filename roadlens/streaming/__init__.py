"""Road-condition analytics: streaming."""
