"""Writers of tables and map files."""
