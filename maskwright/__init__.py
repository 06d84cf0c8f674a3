"""Find, mask and restore sensitive values in Spark tables and streams."""
