"""Plan-level helpers: session settings, scope joins, ordered prefixes, durable cuts."""
