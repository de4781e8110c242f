"""Reading and writing: tables, headline files, vectors, images, catalog state."""
