"""Training-data operators; the rest of the library does not import this subpackage."""
