"""Where series come from: tables and remote-write requests."""
