"""Operators for training-data pipelines over ``documents`` (see README, section "llm")."""
