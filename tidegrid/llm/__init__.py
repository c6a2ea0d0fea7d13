"""Operators of a training-data pipeline: each module holds one, its query and, where SQL can express it, its SQL."""
