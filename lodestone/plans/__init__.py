"""Named queries over the operators, and the SQL they are checked against."""
