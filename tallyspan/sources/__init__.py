"""Sources: the measurement population and plain readers."""
