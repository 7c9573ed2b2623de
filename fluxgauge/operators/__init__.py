"""The engine's operators: functions from DataFrame to DataFrame."""
