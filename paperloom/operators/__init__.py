"""DataFrame operators on documents, tables, runs, pages and reports."""
