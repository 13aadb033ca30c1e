from .build import build_tensor, decode_modes, dense_index, extend_index, index_modes
from .io import (index_grid, index_grid_df, literal_factor, read_csv_tensor, read_tensor,
                 write_csv_tensor, write_tensor)

__all__ = ["build_tensor", "decode_modes", "dense_index", "extend_index", "index_modes", "index_grid", "index_grid_df",
           "literal_factor", "read_csv_tensor", "read_tensor", "write_csv_tensor", "write_tensor"]
