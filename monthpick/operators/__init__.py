"""DataFrame -> DataFrame operators: labels, features, selection, metrics, models."""
