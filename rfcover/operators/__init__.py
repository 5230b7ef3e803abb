"""DataFrame operators: joins, grouping and windows over tables."""
