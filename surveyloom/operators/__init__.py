"""Survey analytics as DataFrame transformations."""
