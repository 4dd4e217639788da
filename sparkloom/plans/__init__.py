"""SQL entry point, plan inspection, and the registry of named queries."""
