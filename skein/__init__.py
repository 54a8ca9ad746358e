"""Full-text search over Spark tables: index build, query compilation, maintenance."""
