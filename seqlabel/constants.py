"""Defaults of the pipeline.

Fixed values: these must equal the original pipeline's settings for the
results to agree, so they are stated here plainly, in their natural order.
"""

# The ten compartment labels, in label order.
COMPARTMENTS = [
    "Cytoplasm", "Nucleus", "Extracellular", "Cell membrane", "Mitochondrion",
    "Plastid", "Endoplasmic reticulum", "Lysosome/Vacuole", "Golgi apparatus",
    "Peroxisome",
]

# The nine sorting-signal labels, in label order.
SIGNALS = ["SP", "TM", "MT", "CH", "TH", "NLS", "NES", "PTS", "GPI"]

# Pipeline parameters.
MAX_LEN = 512          # encoded length, end marker included
THRESHOLD = 0.5        # sigmoid decision threshold
SEED = 77              # sampling / split seed
TEST_SIZE = 0.30       # test share of the train/test split
NUM_RUNS = 5           # repeated evaluation runs
MIN_SEQ_LEN = 40       # eligibility: shortest sequence kept
IDENTITY = 0.30        # homology exclusion threshold
SMOOTH_SIGMA = 2       # Gaussian smoothing of attention scores
LN_EPS = 1e-5          # layer-norm epsilon
HIST_BINS = 10         # probability histogram bins over [0, 1]
KFOLDS = 5             # cross-validation folds
VAL_SHARE = 0.20       # validation share inside each fold's training part
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2   # special token ids
