"""DataFrame operators: filters, joins, aggregates, stencils, windows, flags, models, merging."""
