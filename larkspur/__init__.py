"""A SQL analytics engine on Spark: strict ANSI-style dialect, DataFrame operators, versioned tables."""
