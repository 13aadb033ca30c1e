"""cootensor: sparse multi-way (COO) tensor analytics on Spark DataFrames."""

from .session import VALUE, get_session
from .tensor import modes_of, nnz_density, shape_of, tensor_shape

__all__ = ["VALUE", "get_session", "modes_of", "nnz_density", "shape_of", "tensor_shape"]
