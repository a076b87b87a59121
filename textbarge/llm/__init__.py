"""Operators for training-data pipelines (see README, "Training-data operators")."""
