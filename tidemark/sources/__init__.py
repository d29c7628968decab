"""Sources and sinks of the signal engine."""
