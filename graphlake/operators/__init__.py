"""Query operators: predicates, order, graph assembly, pagination, writes."""
