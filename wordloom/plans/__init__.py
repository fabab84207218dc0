"""End-to-end plans: fixture bindings, registered queries and their SQL oracles."""
