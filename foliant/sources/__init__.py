"""Sources: supplied tables, folder scans, content extraction, snapshots."""
