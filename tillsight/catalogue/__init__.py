"""Named queries over the test tables, each with the equivalent SQL where SQL can say it."""
