"""Spark jobs for the data side of reinforcement learning with verifiable rewards."""
