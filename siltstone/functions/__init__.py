"""Evidence analytics: functions."""
