"""Tables that the analytics start from."""
