"""DataFrame-to-DataFrame operators: audit, constraints, sampling, gates, metrics, fusion."""
