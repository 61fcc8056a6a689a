"""Reading and writing of graphs and of source code."""
