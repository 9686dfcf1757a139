"""Graph operators: store mutations, query tools, search and resolution."""
