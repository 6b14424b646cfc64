"""Column functions: everything here returns a Column and stays inside Catalyst."""
