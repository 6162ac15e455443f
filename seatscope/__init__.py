"""Usage and licence review of audit exports, as Spark DataFrame transforms."""
