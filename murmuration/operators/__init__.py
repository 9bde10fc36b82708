"""DataFrame operators: cleaning, encoding, scoring, metrics and the steps of the swarm."""
