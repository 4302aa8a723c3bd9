"""Rule-conformance analytics over component graphs kept in Spark tables."""
