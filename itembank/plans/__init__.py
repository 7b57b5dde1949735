"""Multi-operator flows and the registered queries."""
