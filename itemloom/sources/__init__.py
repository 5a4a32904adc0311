"""Sources of items and files beside the data: directories, delimited tables, parameters, tags, notes, layouts."""
