"""Plan choice and traces on the driver."""
