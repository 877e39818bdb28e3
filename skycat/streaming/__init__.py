"""Part of skycat: streaming."""
