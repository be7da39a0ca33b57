"""Column functions: binary decoding, text shaping, and the byte-level codecs that have no SQL form."""
