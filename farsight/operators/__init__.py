"""DataFrame operators: search, metrics, statistics, local selectivity, workload shapes, sweep analysis."""
