"""tickloom: declarative market-microstructure features and evaluation on Spark."""
