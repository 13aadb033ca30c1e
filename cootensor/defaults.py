"""Defaults that must equal the reference's for the same results.

Fixed values (reference semantics, kept as given):
"""

HOOI_SWEEPS = 10            # Tucker / HOOI iterations (S9)
ALS_SWEEPS = 10             # tensor-regression sweeps (J8)
CORE_TOP_ROWS = 499_999     # rows kept by the chain's top-k cut: row_number < 500000 (S8)
CHAIN_PRECISION = 0.5       # affine chain after skip: abs > p before the bias (S7)
MODE_PRECISION = 1e-6       # single affine mode product: abs > p before the bias (S7)
PREDICT_PRECISION = 1.0     # prediction: abs > p after the bias (S7)
FIT_PRECISION = 0.0         # threshold the reference's fit loop runs with
RIDGE = 0.001               # ridge on the augmented diagonal, bias included (S13)
N_LAGS = 4                  # lags 0..3 (S17)
TARGET_LAG = 3              # Y = the oldest of the four observations (S18)
INIT_PRECISION = 1e-6       # random / SVD initial factors keep abs > p (S14, S15)
FIT_MIN_PRED = 1.0          # in-loop R² keeps predictions >= 1 (S20)
