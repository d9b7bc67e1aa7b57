"""The library's operators applied to the supplied tables, with SQL oracles."""
