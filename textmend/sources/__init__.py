"""Sources, sinks and the prediction store."""
