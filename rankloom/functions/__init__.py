"""Column-level building blocks; everything here is a pure Column expression unless it says otherwise."""
