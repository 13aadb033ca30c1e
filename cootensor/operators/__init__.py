from .affine import affine_chain, affine_ttm, predict
from .algebra import cross_moment, gram, matrix_add, mode_marginal, spmm_abt, spmm_atb, ttm, ttm_chain
from .metrics import frobenius_mse, mse, r2
from .reshape import (bias_encode, bias_split, cell_lookup, collapse_modes, fold, rebase,
                      rename_modes, time_slice, transpose, unfold, vstack)
from .timelag import complete_times, cut_and_rebase, lag_expand, xy_split
from .truncate import sparsify, top_k

__all__ = ["affine_chain", "affine_ttm", "predict", "cross_moment", "gram", "matrix_add",
           "mode_marginal", "spmm_abt", "spmm_atb", "ttm", "ttm_chain", "frobenius_mse", "mse", "r2",
           "bias_encode", "bias_split", "cell_lookup", "collapse_modes", "fold", "rebase",
           "rename_modes", "time_slice", "transpose", "unfold", "vstack", "complete_times",
           "cut_and_rebase", "lag_expand", "xy_split", "sparsify", "top_k"]
