"""Jobs that write: partitioned builds, script runs, saved intermediate tables."""
