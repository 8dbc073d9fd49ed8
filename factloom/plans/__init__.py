"""Named jobs over tables and the public API."""
