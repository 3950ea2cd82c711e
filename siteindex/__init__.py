"""Site indexes from web-page snapshots, as Spark DataFrame transforms."""
