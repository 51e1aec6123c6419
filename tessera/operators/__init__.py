"""DataFrame operators: counting, co-occurrence, means, search and graphs."""
