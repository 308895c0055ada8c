"""Tables the library reads, writes or brings along."""
