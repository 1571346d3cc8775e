"""End-to-end plans, fixture views over plain tables, and the registered queries."""
