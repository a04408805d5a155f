"""Built-in and user functions, and the portable regular grammar."""
