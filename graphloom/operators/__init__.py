"""DataFrame operators over objects, edges, telemetry and reviews."""
