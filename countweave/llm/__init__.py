"""Text operators for training data: encoding, mixing, personal information. Nothing else in the library imports this."""
