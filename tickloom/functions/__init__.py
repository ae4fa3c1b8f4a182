"""tickloom subpackage."""
