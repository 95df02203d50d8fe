"""Jobs over streams of events."""
