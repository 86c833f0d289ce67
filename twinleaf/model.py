"""The tables that operators exchange.

Front-ends make SUBTREES rows; everything after them is the same for code, markup and text.
file_ord and post_ord order files and, within a file, nodes (children before parents).
An instance is identified by (file, post_ord): two nodes may share a line range.
"""

SUBTREES = "file string, file_ord long, post_ord long, start_line int, end_line int, node_count int, hash binary"
FILES = "path string, file_ord long, content string"
CHANGED_LINES = "file string, line int"
