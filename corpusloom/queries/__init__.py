"""Registered queries over the fixtures and the SQL that says the same. Table: name -> (query, SQL or None)."""
