"""Build planning and the registered queries."""
