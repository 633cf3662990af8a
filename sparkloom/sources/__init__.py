"""Sources, sinks and the dataset store."""
