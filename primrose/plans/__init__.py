"""End-to-end flows and the registered queries."""
