"""Entity-session event-log analytics as plain ``DataFrame -> DataFrame`` functions."""
