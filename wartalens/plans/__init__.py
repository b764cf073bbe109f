"""End-to-end jobs: train, evaluate, score."""
