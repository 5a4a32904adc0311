"""A project's recipes, the plan that they make of source items, the store of results, and refreshes of it."""
