from .expr import above, col_of, hash_uniform, lcg_uniform

__all__ = ["above", "col_of", "hash_uniform", "lcg_uniform"]
