"""The registered queries and the adapters that feed them."""
