"""The same tables kept up to date as files and events arrive."""
