"""Part of skycat: operators."""
