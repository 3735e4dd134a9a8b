"""Sources and sinks: driver tables, derived fixture views, file trees, records."""
