"""Large-corpus operators; nothing outside this subpackage imports it."""
