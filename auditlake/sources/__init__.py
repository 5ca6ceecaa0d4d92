"""Sources: text log files, and an audit-line view of an events table."""
