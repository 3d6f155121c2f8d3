"""Driver workload: tables derived from the given ones, queries over them and their SQL twins."""
