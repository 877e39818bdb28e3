"""Part of skycat: sources."""
