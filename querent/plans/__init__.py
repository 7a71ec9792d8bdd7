"""Plan-level helpers: sessions, staged tables, skew-safe ranking and joins."""
