"""Where tables come from: landed review files, the catalogue, reference texts."""
