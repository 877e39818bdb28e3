"""Part of skycat: functions."""
