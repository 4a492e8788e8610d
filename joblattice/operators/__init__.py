"""DataFrame operators: standardise, filter, search, facet, maintain."""
