"""DataFrame operators: filters, joins, sampling/splitting, TF-IDF,
balancing, metrics, error/bias analytics, models."""
