"""Fixed values of the task: splits, phone locations, classes, channels, matrix shape."""

from __future__ import annotations

# These must stay as they are for results to be comparable.
SPLITS = ("train", "validation", "test")
TRAIN_LOCATIONS = ("Bag", "Hips", "Torso", "Hand")
TEST_LOCATIONS = ("Bag", "Hips", "Torso")
N_CLASSES = 8
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8)
CLASS_NAMES = {
    1: "Still",
    2: "Walk",
    3: "Run",
    4: "Bike",
    5: "Car",
    6: "Bus",
    7: "Train",
    8: "Subway",
}
CHANNELS = (
    "Acc_x",
    "Acc_y",
    "Acc_z",
    "Gyr_x",
    "Gyr_y",
    "Gyr_z",
    "Magn_x",
    "Magn_y",
    "Magn_z",
)
SAMPLES_PER_FRAME = 500
FRAMES_PER_FILE = {"train": 196_072, "validation": 28_789}
# All locations of the split together.
FRAMES_PER_SPLIT = {"test": 92_726}
EXPECTED_SHARDS = (
    ("train", "Bag"),
    ("train", "Hips"),
    ("train", "Torso"),
    ("train", "Hand"),
    ("validation", "Bag"),
    ("validation", "Hips"),
    ("validation", "Torso"),
    ("validation", "Hand"),
    ("test", "Bag"),
    ("test", "Hips"),
    ("test", "Torso"),
)
LABELLED_SPLITS = ("train", "validation")
EXPECTED_ROWS = 92_726
EXPECTED_COLS = 500
DEFAULT_POOLING = "mean"
RUN_COLUMNS = (
    "experiment",
    "run_name",
    "macro_f1",
    "accuracy",
    "fm",
    "head",
    "student",
    "git_sha",
    "git_dirty",
    "start_time",
    "run_id",
)
# Formats of texts that people and scripts read.
HEADLINE = "macro-F1=%.4f  acc=%.4f  n=%d  weakest=class %d (F1=%.3f)"
WRONG_ROWS = "expected %d rows, got %d"
WRONG_COLS = "expected %d cols, got %s"
NAN_ENTRIES = "%d NaN entries"
NON_INTEGER = "non-integer entries present"
STRAY_LABELS = "labels outside allowed set: [%s]"
MISSING_FILE = "missing: %s"
HASH_MISMATCH = "hash mismatch: %s (expected %s, got %s)"
MANIFEST_LINE = "%s  %s"
# End of fixed values.

#: Location directory of the test split, whose frames are mixed over locations.
POOLED_LOCATION = "all"
#: Name of the label file that lies next to the channel files.
LABEL_CHANNEL = "Label"
