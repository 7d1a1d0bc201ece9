"""Named queries over the supplied tables, each with a SQL twin where one exists."""
