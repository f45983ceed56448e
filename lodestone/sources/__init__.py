"""Sources and sinks: fetched webs, robots files, tables, JSON and CSV."""
