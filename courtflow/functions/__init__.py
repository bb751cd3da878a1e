"""Column-expression functions; everything here stays inside codegen."""
