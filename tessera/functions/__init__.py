"""Column-level building blocks: values, paths, filters, expressions, geometry."""
