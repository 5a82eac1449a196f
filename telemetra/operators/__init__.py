"""DataFrame → DataFrame operators (flatten, filters, views, aggregates, series, stores)."""
