"""Column functions: sequence primitives and number decoders, all native expressions."""
