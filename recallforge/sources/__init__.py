"""Sources and sinks: segments, manifests, write-ahead log, cold vectors, JSON lines, vector files."""
