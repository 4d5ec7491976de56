"""Sources, sinks and views."""
