"""Sources and sinks: the binary operation log, telemetry, JSON."""
