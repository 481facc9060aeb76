"""Sources: number lists, record fixtures, publication exports, bulk XML, legal status, worksheets."""
