"""Analytics of tracked animals on Spark: trajectories, states, bouts, events, interactions and their statistics."""
