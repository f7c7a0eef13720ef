"""Assembly: the test-table mapping, the query catalogue and its SQL oracle."""
