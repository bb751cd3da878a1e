"""Input tables and the registered queries."""
