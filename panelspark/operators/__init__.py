"""Multi-row operators: joins, aggregates, ranks, windows, reshapes and contrasts."""
