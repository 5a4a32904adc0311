"""Live sources: a listing stream and its micro-batches."""
