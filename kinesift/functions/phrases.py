"""Words and phrases of cards, captions and evidence texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: results must carry exactly these words -------------------------------------

FIELDS = ["intensity", "periodicity", "dominant_axis", "dominant_frequency", "burstiness"]

BASE_AXES = {
    "acc_x": "forward-back acceleration trace",
    "acc_y": "side-to-side acceleration trace",
    "acc_z": "vertical acceleration trace",
    "gyro_x": "roll-rate gyroscope trace",
    "gyro_y": "pitch-rate gyroscope trace",
    "gyro_z": "yaw-rate gyroscope trace",
    "uncertain": "no single channel clearly dominates",
}

BODY_AXES = {
    "chest_acc_x": "chest forward-back acceleration trace",
    "chest_acc_y": "chest side-to-side acceleration trace",
    "chest_acc_z": "chest vertical acceleration trace",
    "ankle_acc_x": "ankle forward-back acceleration trace",
    "ankle_acc_y": "ankle side-to-side acceleration trace",
    "ankle_acc_z": "ankle vertical acceleration trace",
    "ankle_gyro_x": "ankle roll-rate gyroscope trace",
    "ankle_gyro_y": "ankle pitch-rate gyroscope trace",
    "ankle_gyro_z": "ankle yaw-rate gyroscope trace",
    "ankle_mag_x": "ankle magnetometer x trace",
    "ankle_mag_y": "ankle magnetometer y trace",
    "ankle_mag_z": "ankle magnetometer z trace",
    "arm_acc_x": "arm forward-back acceleration trace",
    "arm_acc_y": "arm side-to-side acceleration trace",
    "arm_acc_z": "arm vertical acceleration trace",
    "arm_gyro_x": "arm roll-rate gyroscope trace",
    "arm_gyro_y": "arm pitch-rate gyroscope trace",
    "arm_gyro_z": "arm yaw-rate gyroscope trace",
    "arm_mag_x": "arm magnetometer x trace",
    "arm_mag_y": "arm magnetometer y trace",
    "arm_mag_z": "arm magnetometer z trace",
}

INTENSITY_PHRASES = {
    "low": "small-amplitude movement",
    "medium": "moderate-amplitude movement",
    "high": "large-amplitude movement",
}

PERIODICITY_PHRASES = {
    "none": "little repeatable rhythm",
    "weak": "an irregular but noticeable rhythm",
    "strong": "a clearly repeated rhythm",
}

FREQUENCY_PHRASES = {
    "low": "a slow cadence",
    "mid": "a mid-paced cadence",
    "high": "a quick cadence",
    "uncertain": "no stable cadence estimate",
}

BURST_PHRASES = {
    "smooth": "changes remain fairly even rather than spiky",
    "bursty": "the trace contains short, spiky bursts",
}

TREND_WORDS = {"rise": "rising", "fall": "falling", "stable": "steady"}

BAND_HINTS = {
    "low": "below the lower reference band",
    "medium": "inside the middle reference band",
    "high": "above the upper reference band",
    "none": "below the repeatability reference",
    "weak": "near the repeatability reference",
    "strong": "above the repeatability reference",
    "uncertain": "without a stable reference crossing",
}
OTHER_BAND = "outside the expected reference band"

# Clauses of the third hard variant.
V3_INTENSITY = {"low": "subtle energy", "medium": "moderate energy", "high": "forceful energy"}
V3_PERIODICITY = {"none": "little repeatable rhythm", "weak": "a loose rhythm", "strong": "a repeatable rhythm"}
V3_FREQUENCY = {
    "low": "slow cadence",
    "mid": "middle-rate cadence",
    "high": "fast cadence",
    "uncertain": "no stable cadence",
}
V3_BURST = {"smooth": "an even profile", "bursty": "short spikes"}

# Edits that turn a card value into a contradicting one.
EASY_EDITS = {
    "intensity": ({"low": "high", "medium": "low", "high": "low"}, "high"),
    "periodicity": ({"none": "strong", "weak": "none", "strong": "none"}, "strong"),
    "dominant_frequency": ({"low": "high", "mid": "low", "high": "low", "uncertain": "mid"}, "mid"),
}
HARD_EDITS = {
    "intensity": ({"low": "high", "medium": "high", "high": "low"}, "high"),
    "periodicity": ({"none": "strong", "weak": "strong", "strong": "none"}, "strong"),
    "dominant_frequency": ({"low": "high", "mid": "low", "high": "low", "uncertain": "mid"}, "mid"),
}

# Phrases that make a caption claim a value; within a field the first one found decides.
CLAIM_PHRASES = {
    "intensity": [
        ("subtle energy", "low"),
        ("small-amplitude movement", "low"),
        ("moderate energy", "medium"),
        ("moderate-amplitude movement", "medium"),
        ("forceful energy", "high"),
        ("large-amplitude movement", "high"),
    ],
    "periodicity": [
        ("little repeatable rhythm", "none"),
        ("loose rhythm", "weak"),
        ("repeatable rhythm", "strong"),
    ],
    "dominant_frequency": [
        ("slow cadence", "low"),
        ("middle-rate cadence", "mid"),
        ("mid-paced cadence", "mid"),
        ("fast cadence", "high"),
        ("quick cadence", "high"),
        ("no stable cadence", "uncertain"),
    ],
    "burstiness": [
        ("an even profile", "smooth"),
        ("smooth movement pattern", "smooth"),
        ("short spikes", "bursty"),
        ("spiky bursts", "bursty"),
    ],
}

# The wider set, which also reads the easy captions and paraphrases.
STATEMENT_PHRASES = {
    "intensity": [
        ("small-amplitude movement", "low"),
        ("subtle energy", "low"),
        ("contains low motion", "low"),
        ("motion intensity is low", "low"),
        ("moderate-amplitude movement", "medium"),
        ("moderate energy", "medium"),
        ("contains medium motion", "medium"),
        ("motion intensity is medium", "medium"),
        ("large-amplitude movement", "high"),
        ("forceful energy", "high"),
        ("contains high motion", "high"),
        ("motion intensity is high", "high"),
    ],
    "periodicity": [
        ("little repeatable rhythm", "none"),
        ("none periodicity", "none"),
        ("an irregular but noticeable rhythm", "weak"),
        ("a loose rhythm", "weak"),
        ("loose rhythm", "weak"),
        ("weak periodicity", "weak"),
        ("strong rhythm", "strong"),
        ("a repeatable rhythm", "strong"),
        ("repeatable rhythm", "strong"),
        ("clearly repeated rhythm", "strong"),
        ("strong periodicity", "strong"),
    ],
    "dominant_frequency": [
        ("a slow cadence", "low"),
        ("slow cadence", "low"),
        ("a mid-paced cadence", "mid"),
        ("mid-paced cadence", "mid"),
        ("middle-rate cadence", "mid"),
        ("a quick cadence", "high"),
        ("quick cadence", "high"),
        ("fast cadence", "high"),
        ("no stable cadence", "uncertain"),
    ],
    "burstiness": [
        ("changes remain fairly even rather than spiky", "smooth"),
        ("an even profile", "smooth"),
        ("even profile", "smooth"),
        ("smooth movement pattern", "smooth"),
        ("movement is smooth", "smooth"),
        ("short spikes", "bursty"),
        ("spiky bursts", "bursty"),
        ("movement is bursty", "bursty"),
    ],
}

NUMERIC_PATTERNS = {
    "rms_energy": r"RMS energy is\s+([-+]?\d+(?:\.\d+)?)",
    "autocorr_peak": r"autocorrelation\s+([-+]?\d+(?:\.\d+)?)",
    "fft_dominant_ratio": r"FFT concentration\s+([-+]?\d+(?:\.\d+)?)",
    "dominant_frequency_hz": r"dominant spectral peak is\s+([-+]?\d+(?:\.\d+)?)\s*Hz",
    "peak_count": r"Peak count is\s+([-+]?\d+(?:\.\d+)?)",
}

SHORTCUT_PHRASES = [
    "supported description",
    "description claims",
    "this description",
    "supported by",
    "unsupported",
]

HIDDEN_CONTROL_TEXT = "Evidence is hidden for this control condition."
HIDDEN_STRESS_TEXT = "Instance-specific sensor evidence is hidden for this control condition."

ACTIVITY_LABELS_6 = {
    1: "walking",
    2: "walking_upstairs",
    3: "walking_downstairs",
    4: "sitting",
    5: "standing",
    6: "laying",
}

ACTIVITY_LABELS_12 = {
    1: "standing_still",
    2: "sitting_relaxing",
    3: "lying_down",
    4: "walking",
    5: "climbing_stairs",
    6: "waist_bends_forward",
    7: "frontal_arm_elevation",
    8: "knees_bending",
    9: "cycling",
    10: "jogging",
    11: "running",
    12: "jump_front_back",
}

# ---- End of fixed values ----------------------------------------------------------------------

AXIS_WORDS = {**BASE_AXES, **BODY_AXES}

VOCABULARY = {
    "intensity": ["low", "medium", "high"],
    "periodicity": ["none", "weak", "strong"],
    "dominant_axis": list(AXIS_WORDS),
    "dominant_frequency": ["low", "mid", "high", "uncertain"],
    "burstiness": ["smooth", "bursty"],
}


def axis_options(dataset_id: str | None) -> list[str]:
    """The axes a dataset can name, ``uncertain`` last."""
    if dataset_id == "mhealth":
        return [*BODY_AXES, "uncertain"]
    if dataset_id == "wisdm":
        return ["acc_x", "acc_y", "acc_z", "uncertain"]
    return list(BASE_AXES)


def axis_mentions() -> list[tuple[str, str]]:
    """(phrase, axis) from the longest phrase to the shortest; spelled-out codes count as phrases."""
    known = [(words, axis) for axis, words in AXIS_WORDS.items()]
    known += [(axis.replace("_", " "), axis) for axis in AXIS_WORDS if axis != "uncertain"]
    return sorted(known, key=lambda m: -len(m[0]))


def quoted(text: object) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def worded(value: Column, words: dict, otherwise: Column | None = None) -> Column:
    """``words[value]``, looked up in one map literal."""
    pairs = ", ".join(f"{k if isinstance(k, int) else quoted(k)}, {quoted(v)}" for k, v in words.items())
    found = F.try_element_at(F.expr(f"map({pairs})"), value)
    return found if otherwise is None else F.coalesce(found, otherwise)


def spelled(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit(" "))


def axis_phrase(axis: Column) -> Column:
    return worded(axis, AXIS_WORDS, spelled(axis))


def other_than(current: Column, options: list[str]) -> Column:
    """The first option that differs from ``current``."""
    return F.when(current == options[0], options[1]).otherwise(options[0])


def other_axis(dataset_id: Column, current: Column) -> Column:
    return (
        F.when(dataset_id == "mhealth", other_than(current, axis_options("mhealth")))
        .when(dataset_id == "wisdm", other_than(current, axis_options("wisdm")))
        .otherwise(other_than(current, axis_options(None)))
    )


def axis_allowed(dataset_id: Column, axis: Column) -> Column:
    return (
        F.when(dataset_id == "mhealth", axis.isin(axis_options("mhealth")))
        .when(dataset_id == "wisdm", axis.isin(axis_options("wisdm")))
        .otherwise(axis.isin(axis_options(None)))
    )


def fixed_point(value: Column, digits: int) -> Column:
    """``value`` with 0 or 3 decimals; a number halfway between two goes to the even one, as in C.

    The formatter rounds the shortest decimal text of a number. Where that ends halfway, the number itself lies above,
    below or on the middle: which, tells the exact remainder, made of two products of halves that have no rounding.
    """
    if digits == 0:
        return F.format_string("%.0f", F.bround(value, 0))
    steps = 2.0 * 10**digits
    size = F.abs(value)
    middle = 2 * F.floor(size * steps / 2) + 1
    split = size * 134217729.0
    high = split - (split - size)
    rest = (high * steps - middle) + (size - high) * steps
    near = F.abs(rest) < 1e-6
    to = F.when(rest > 0, middle + 1).when(rest < 0, middle - 1).otherwise(2 * F.bround(middle / 2.0, 0))
    sign = F.when(value < 0, -1.0).otherwise(1.0)
    return F.format_string(f"%.{digits}f", F.when(near, sign * (to / 2 / 10**digits)).otherwise(value))
