"""What Spark's own SQL parser says about statements."""
