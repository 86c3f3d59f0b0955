"""DataFrame operators: joins in space, aggregates, sampling, metrics, statistics, models."""
