"""Plans that put functions and operators together, and the queries registered for the driver."""
