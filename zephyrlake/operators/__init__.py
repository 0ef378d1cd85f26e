"""DataFrame operators: cleaning, time series, joins, fires, networks, rules, grids, evaluation, upserts and models."""
