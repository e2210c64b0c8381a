"""Session-log analytics on Spark: ordered event sequences, whole-session transactions,
integrity validation, versioned commits and projections over many sessions at once."""
