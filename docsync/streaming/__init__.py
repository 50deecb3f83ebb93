"""Change events: as a stream, and the same steps in batch form."""
