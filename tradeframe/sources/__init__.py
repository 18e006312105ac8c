"""Tables: declared schemas, readers and writers, reference rows, business views."""
