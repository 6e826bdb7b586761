"""See SURVEY for the operators that live here."""
