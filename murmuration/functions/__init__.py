"""Column expressions: everything here is evaluated by Catalyst, without Python workers."""
