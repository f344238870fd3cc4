"""Column functions over DNA strings, all inside Catalyst."""
