"""Report plans: several operators over one pass of the logs."""
