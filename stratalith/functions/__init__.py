"""Part of the code knowledge base: functions."""
