"""Road-condition analytics: functions."""
