"""Column expressions: text, tokens, credential shapes, masking, paths, links."""
