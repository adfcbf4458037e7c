"""The registered queries of the library and the SQL they are held against."""
