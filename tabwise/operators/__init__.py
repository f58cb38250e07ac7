"""DataFrame operators: profiling, preparation, splitting, metrics, clustering, models."""
