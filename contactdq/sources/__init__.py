"""sources of the contact-data engine."""
