"""Column expressions, statistics, sampling and ranking that the operators share."""
