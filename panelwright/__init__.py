"""Entity x time panel analytics on Spark: functions from DataFrame to DataFrame."""
