"""operators of the contact-data engine."""
