"""Readers and writers: patches, file snapshots, tool logs, stored tables, rules."""
