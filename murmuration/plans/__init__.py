"""Complete jobs: feature tables, training, sweeps and evaluation."""
