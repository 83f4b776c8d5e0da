"""Operators for training-data pipelines, one module per problem; nothing outside imports them."""
