"""Named queries over the test tables and, where SQL can say the same, their SQL."""
