"""Sources and sinks: folders of tables, a read-only database, reports, traces."""
