"""Part of lodestrata: functions."""
