"""Sources, sinks and the domain views."""
