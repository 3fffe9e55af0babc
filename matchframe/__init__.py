"""matchframe: dated head-to-head analytics as Spark DataFrame operators."""
