"""Writers of small workbooks for tests and queries."""
