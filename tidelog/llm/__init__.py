"""Training-data operators. Nothing outside this subpackage imports it; removing the folder leaves the rest whole."""
