"""Result files: tables of formatted lines, written with a header and gzip."""
