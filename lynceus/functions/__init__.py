"""Column expressions: hash uniforms, row-level scores and small statistical helpers."""
