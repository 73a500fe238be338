"""End-to-end jobs and the queries registered for the driver."""
