"""Portfolio analytics as Spark jobs: event logs to positions, signals, targets, orders and statistics."""
