"""Plans over the operators: a whole run and what is read from it."""
