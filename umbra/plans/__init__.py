"""Planning: the ladder of instants, costs, the chain of steps, and the query registry."""
