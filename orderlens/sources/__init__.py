"""Reading and writing: order files, the star schema, snapshots, series files."""
