"""Complete jobs: the audited run, and the queries registered with the driver."""
