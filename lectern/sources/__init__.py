"""Sources and sinks: explicit schemas, explicit paths."""
