"""Tables and files that the registered queries run on where the given tables lack what they need; only queries import them."""
