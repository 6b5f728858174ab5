"""plans of the contact-data engine."""
